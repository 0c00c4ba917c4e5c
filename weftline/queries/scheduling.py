"""Queries of the scheduling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.outcomes import truncate_bytes
from weftline.operators import scheduling as sched
from weftline.operators.ranking import ranked
from weftline.registry import query
from weftline.sources.fixtures import NOW_MS, policy, runs, table, tasks, with_tables

DAY = 86_400_000


@query("B1", sql="SELECT o_custkey AS task_id, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def insert_once(spark, sf_dir):
    """A known id records nothing more."""
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), "o_orderkey", "o_orderpriority")
    return sched.insert_once(df, "task_id", ["o_orderkey"])


_ADMIT = """CASE WHEN bytes * 7 > 7000 THEN 'payload_too_large' WHEN task_id % 6 = 0 AND task_id % 4 = 0 THEN 'too_large' WHEN bytes + 300 > 1150 THEN 'too_large'
  WHEN task_id % 4 = 0 AND bytes + 300 + task_id % 800 > 1150 THEN 'key_backpressure' WHEN task_id % 5000 + bytes * 7 > 7000 THEN 'backpressure' ELSE 'accepted' END"""


@query("B2", sql=with_tables("tasks", f"SELECT task_id, {_ADMIT} AS verdict FROM tasks"))
def admission_class(spark, sf_dir):
    """Why submissions are refused, by the first check that fails."""
    verdict = sched.admission(F.col("bytes") * 7, F.col("task_id") % 6 == 0, F.col("task_id") % 4 == 0, F.col("bytes") + 300, F.col("task_id") % 800, F.col("task_id") % 5000, 7000, 1150)
    return tasks(spark, sf_dir).select("task_id", verdict.alias("verdict"))


@query("B3", sql=with_tables("tasks", """
, b AS (SELECT coalescing_key, list(bytes ORDER BY submitted_ms, ticket) AS sizes, list(task_id ORDER BY submitted_ms, ticket) AS ids FROM tasks GROUP BY coalescing_key),
r AS (SELECT coalescing_key, sizes, ids, 0::BIGINT AS i, 0::BIGINT AS used, NULL::BOOLEAN AS accepted FROM b UNION ALL
  SELECT coalescing_key, sizes, ids, i + 1, CASE WHEN used + sizes[i + 1] <= 8000 THEN used + sizes[i + 1] ELSE used END, used + sizes[i + 1] <= 8000 FROM r WHERE i < len(sizes))
SELECT ids[i] AS task_id, accepted FROM r WHERE i > 0""").replace(") \n, b AS", "), b AS").replace("WITH tasks", "WITH RECURSIVE tasks"))  # fmt: skip
def memory_budget(spark, sf_dir):
    """Greedy acceptance under a budget: refused submissions take no room."""
    return sched.budget_in_order(tasks(spark, sf_dir), ["coalescing_key"], ["submitted_ms", "ticket", "task_id"], "bytes", 8000).select("task_id", "accepted")


@query("B4", sql=with_tables("tasks", """
SELECT task_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY queue ORDER BY submitted_ms, ticket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS slow_down
FROM (SELECT *, CASE WHEN bytes > 800 THEN 1 WHEN 100 * bytes <= 80 * 800 THEN 0 END AS mark FROM tasks)"""))  # fmt: skip
def slow_down_hysteresis(spark, sf_dir):
    """Raised above the soft limit, cleared at four fifths of it."""
    return sched.hysteresis(tasks(spark, sf_dir), ["queue"], ["submitted_ms", "ticket"], F.col("bytes"), F.lit(800)).select("task_id", "slow_down")


@query("B5", "B7", sql=with_tables("tasks", f"SELECT task_id, submitted_ms + delay_ms AS due_ms, row_number() OVER (PARTITION BY queue ORDER BY submitted_ms + delay_ms, ticket) AS place FROM tasks WHERE delay_ms IS NOT NULL AND submitted_ms + delay_ms <= {NOW_MS - 10 * DAY}"))
def delay_release(spark, sf_dir):
    """Delayed tasks that are due, earliest first, with the ticket they get in their queue."""
    due = sched.due_delayed(tasks(spark, sf_dir), NOW_MS - 10 * DAY).select("queue", "task_id", "due_ms", "ticket")
    return ranked(due, ["queue"], ["due_ms", "ticket"], "place").select("task_id", "due_ms", "place")


@query("B6", sql=with_tables("runs", f"SELECT task_id, submitted_ms + expiry_ms AS due_ms FROM tasks t WHERE expiry_ms IS NOT NULL AND submitted_ms + expiry_ms <= {NOW_MS} AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.task_id = t.task_id AND r.state IN ('claimed', 'running', 'succeeded'))"))
def expire_pending(spark, sf_dir):
    """Tasks past their expiry that nobody claimed."""
    claimed = runs(spark, sf_dir).where("state in ('claimed', 'running', 'succeeded')")
    return sched.expired(tasks(spark, sf_dir), claimed, NOW_MS).select("task_id", "due_ms")


_CLAIM = f"""
, busy AS (SELECT queue, count(*) AS running FROM runs WHERE state IN ('claimed', 'running') AND task_id % 50 = 2 GROUP BY queue),
a AS (SELECT t.*, p.priority, p.weight, p.age_ms, p.max_running, coalesce(b.running, 0) AS running, row_number() OVER (PARTITION BY t.queue ORDER BY ticket) AS nth
      FROM tasks t JOIN policy p USING (queue) LEFT JOIN busy b USING (queue)),
c AS (SELECT *, age_ms IS NOT NULL AND {NOW_MS} - submitted_ms > age_ms AS starving FROM a WHERE max_running IS NULL OR nth <= max_running - running),
d AS (SELECT *, row_number() OVER (PARTITION BY queue, starving ORDER BY ticket) - 1 AS p FROM c)
SELECT task_id, queue, starving, CASE WHEN starving THEN 0 ELSE priority END AS tier, CASE WHEN starving THEN 0 ELSE p // weight END AS round, ticket FROM d
ORDER BY starving DESC, tier DESC, round, ticket LIMIT 500"""


@query("B8", "B9", "B10", "B11", sql=with_tables("tasks runs policy", _CLAIM).replace(") \n, busy", "), busy"))
def fair_claim_topk(spark, sf_dir):
    """The 500 tasks of one claim, weighted-fair over queues."""
    busy = runs(spark, sf_dir).where("state in ('claimed', 'running') and task_id % 50 = 2").groupBy("queue").agg(F.count("*").alias("running"))
    return sched.fair_claim(tasks(spark, sf_dir), policy(spark), busy, NOW_MS, 500)


@query("B11", "B12", sql=with_tables("tasks", """
SELECT queue, task_id FROM (SELECT queue, task_id, row_number() OVER (PARTITION BY queue ORDER BY ticket) AS n FROM tasks WHERE queue IN ('view', 'click', 'error') AND NOT non_retriable AND task_id % 4 <> 0) WHERE n = 1"""))  # fmt: skip
def first_claimable(spark, sf_dir):
    """The first task of each subscribed queue that is neither passed over nor held back."""
    df = tasks(spark, sf_dir)
    subscribed = spark.createDataFrame([("view",), ("click",), ("error",)], "queue string")
    held = df.where("non_retriable or task_id % 4 = 0").select("task_id")
    free = df.join(F.broadcast(subscribed), "queue", "left_semi").join(held, "task_id", "left_anti")
    return free.groupBy("queue").agg(F.min_by("task_id", "ticket").alias("task_id"))


@query("B13", sql=with_tables("tasks", """
, f AS (SELECT coalescing_key, min(submitted_ms::HUGEINT * 100000000 + ticket) AS first FROM tasks WHERE bytes <= 900 GROUP BY coalescing_key)
SELECT task_id FROM (SELECT t.*, sum(bytes) OVER (PARTITION BY coalescing_key ORDER BY submitted_ms, ticket ROWS UNBOUNDED PRECEDING) AS run FROM tasks t JOIN f USING (coalescing_key) WHERE submitted_ms::HUGEINT * 100000000 + ticket >= first) WHERE run <= 900""").replace(") \n, f AS", "), f AS"))  # fmt: skip
def batch_fit(spark, sf_dir):
    """A batch stops at the first task that doesn't fit; misfits at its head are passed over."""
    return sched.batch_fit(tasks(spark, sf_dir), ["coalescing_key"], ["submitted_ms", "ticket"], "bytes", 900).select("task_id")


@query("B14", sql=with_tables("runs", """
, s AS (SELECT task_id, arg_max(state, attempt) AS state FROM runs WHERE task_id % 17 <> 3 GROUP BY task_id),
a AS (SELECT t.task_id, w.w AS worker, t.submitted_ms + (t.task_id * (w.w + 3)) % 50 AS asked_ms FROM tasks t, (SELECT unnest([1, 2, 3])::BIGINT AS w) w)
SELECT task_id, worker, CASE WHEN state IS NULL THEN 'task_unknown' WHEN state = 'superseded' THEN 'superseded' WHEN state IN ('succeeded', 'failed', 'expired', 'cancelled', 'lost', 'orphaned') THEN 'finished'
  WHEN state IN ('claimed', 'running') THEN 'already_selected' WHEN state = 'scheduled' THEN 'not_ready'
  WHEN row_number() OVER (PARTITION BY task_id ORDER BY asked_ms, worker) = 1 THEN 'granted' ELSE 'already_selected' END AS answer FROM a LEFT JOIN s USING (task_id)""").replace(") \n, s AS", "), s AS"))  # fmt: skip
def named_claims(spark, sf_dir):
    """The first asker of a queued task wins."""
    asks = tasks(spark, sf_dir).select("task_id", "submitted_ms", F.explode(F.array(*(F.lit(w).cast("bigint") for w in (1, 2, 3)))).alias("worker"))
    asks = asks.select("task_id", "worker", (F.col("submitted_ms") + F.col("task_id") * (F.col("worker") + 3) % 50).alias("asked_ms"))
    state = sched.newest_run(runs(spark, sf_dir).where("task_id % 17 <> 3")).select("task_id", "state")
    return sched.arbitrate(asks, state)


@query("B14", sql=with_tables("runs", """
, s AS (SELECT task_id, arg_max(state, attempt) AS state FROM runs WHERE task_id % 17 <> 3 GROUP BY task_id),
a AS (SELECT t.task_id, w.w AS worker, t.submitted_ms + (t.task_id * (w.w + 3)) % 50 AS asked_ms, t.task_id % 19 <> w.w AS is_leader, t.task_id % 23 <> w.w AS is_member, t.task_id % 5 <> w.w AS can_run, t.task_id % 7 <> w.w AS subscribed
  FROM tasks t, (SELECT unnest([1, 2, 3])::BIGINT AS w) w)
SELECT task_id, worker, CASE WHEN NOT is_leader THEN 'not_leader' WHEN NOT is_member THEN 'not_member' WHEN state IS NULL THEN 'task_unknown' WHEN state = 'superseded' THEN 'superseded'
  WHEN state IN ('succeeded', 'failed', 'expired', 'cancelled', 'lost', 'orphaned') THEN 'finished' WHEN state IN ('claimed', 'running') THEN 'already_selected' WHEN state = 'scheduled' THEN 'not_ready'
  WHEN NOT can_run THEN 'cannot_run' WHEN NOT subscribed THEN 'not_subscribed' WHEN task_id % 11 = 4 THEN 'key_busy' WHEN task_id % 13 = 6 THEN 'queue_full'
  WHEN row_number() OVER (PARTITION BY task_id ORDER BY is_leader AND is_member AND can_run AND subscribed DESC, asked_ms, worker) = 1 THEN 'granted' ELSE 'already_selected' END AS answer FROM a LEFT JOIN s USING (task_id)""").replace(") \n, s AS", "), s AS"))  # fmt: skip
def claim_refusals(spark, sf_dir):
    """Named claims with every reason that a claimant or a task can be refused for."""
    t, w = F.col("task_id"), F.col("worker")
    asks = tasks(spark, sf_dir).select("task_id", "submitted_ms", F.explode(F.array(*(F.lit(n).cast("bigint") for n in (1, 2, 3)))).alias("worker"))
    asks = asks.select("task_id", "worker", (F.col("submitted_ms") + t * (w + 3) % 50).alias("asked_ms"), (t % 19 != w).alias("is_leader"), (t % 23 != w).alias("is_member"), (t % 5 != w).alias("can_run"), (t % 7 != w).alias("subscribed"))
    state = sched.newest_run(runs(spark, sf_dir).where("task_id % 17 <> 3")).select("task_id", "state", (t % 11 == 4).alias("key_busy"), (t % 13 == 6).alias("queue_full"))
    return sched.arbitrate(asks, state)


@query("B7", sql=with_tables("runs", """
, e AS (SELECT queue, task_id, attempt, updated_ms AS moved, CASE WHEN task_id % 3 = 0 THEN 3600000 END AS expiry_ms FROM runs),
n AS (SELECT queue, task_id, max(attempt) AS attempt, arg_max(moved, attempt) AS moved, arg_max(coalesce(expiry_ms, -1), attempt) AS expiry FROM e GROUP BY queue, task_id)
SELECT queue, task_id, attempt, CASE WHEN attempt = 1 AND expiry >= 0 THEN expiry END AS expiry_ms, row_number() OVER (PARTITION BY queue ORDER BY moved, task_id) AS place FROM n""").replace(") \n, e AS", "), e AS"))  # fmt: skip
def requeue_order(spark, sf_dir):
    """Tasks tried again stand at the back of their queue and have lost their expiry."""
    events = runs(spark, sf_dir).select("queue", "task_id", "attempt", F.col("updated_ms").alias("at"), F.when(F.col("task_id") % 3 == 0, F.lit(3_600_000)).alias("expiry_ms"))
    return sched.requeued(events)


@query("B11", sql="""
SELECT o_orderkey, CASE WHEN len(s) = 0 THEN array_to_string(list_sort(a), ',') WHEN len(a) = 0 THEN array_to_string(list_sort(s), ',') WHEN len(list_intersect(s, a)) > 0 THEN array_to_string(list_sort(list_intersect(s, a)), ',') END AS queues
FROM (SELECT o_orderkey, list_filter([0, 1, 2, 3], lambda q: (o_custkey + q) % 3 = 0 AND o_custkey % 5 <> 0) AS s, list_filter([0, 1, 2, 3], lambda q: (o_orderkey + q) % 2 = 0 AND o_orderkey % 7 <> 0) AS a FROM orders)""")  # fmt: skip
def claimed_queues(spark, sf_dir):
    """The queues that a worker takes and is asked for; an empty list stands for every queue."""
    every = F.array(*(F.lit(q) for q in range(4)))
    takes = F.filter(every, lambda q: ((F.col("o_custkey") + q) % 3 == 0) & (F.col("o_custkey") % 5 != 0))
    asked = F.filter(every, lambda q: ((F.col("o_orderkey") + q) % 2 == 0) & (F.col("o_orderkey") % 7 != 0))
    queues = sched.taken_queues(takes, asked)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(queues, lambda q: q.cast("string")), ",").alias("queues"))


_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in sched.EDGES)


@query("B15", sql=with_tables("runs", f"""
SELECT task_id, from_state, state FROM (SELECT task_id, state, lag(state) OVER (PARTITION BY task_id ORDER BY attempt) AS from_state FROM runs)
WHERE from_state IS NOT NULL AND from_state <> state AND (from_state, state) NOT IN (SELECT (a, b) FROM (VALUES {_EDGES}) e(a, b))"""))  # fmt: skip
def illegal_transitions(spark, sf_dir):
    """Successive states without a legal edge."""
    return sched.illegal_transitions(runs(spark, sf_dir), ["task_id"], ["attempt"]).select("task_id", "from_state", "state")


@query("B18", sql=with_tables("runs", """
, n AS (SELECT task_id, max(attempt) AS attempt, arg_max(state, attempt) AS state, any_value(max_retries) AS max_retries, count(*) FILTER (state = 'lost') AS losses FROM runs GROUP BY task_id)
SELECT task_id, attempt, losses, attempt - losses <= max_retries AS retried FROM n WHERE state = 'failed'""").replace(") \n, n AS", "), n AS"))  # fmt: skip
def retry_decision(spark, sf_dir):
    """Failed tasks with tries left; losses are not tries."""
    r = runs(spark, sf_dir)
    return sched.retry_decision(sched.newest_run(r), r).select("task_id", "attempt", "losses", "retried")


@query("B19", sql="""
SELECT doc_id, left(text, n) AS message, octet_length(encode(left(text, n))) AS size FROM (
  SELECT doc_id, text, list_max(list_filter(generate_series(least(length(text), 32), least(length(text), 128)), lambda i: octet_length(encode(left(text, i))) <= 128)) AS n FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def failure_text(spark, sf_dir):
    """Failure messages cut at 128 bytes without splitting a character."""
    df = table(spark, sf_dir, "documents").where("text is not null")
    cut = truncate_bytes(F.col("text"), 128)
    return df.select("doc_id", cut.alias("message"), F.octet_length(cut).alias("size"))


@query("B20", sql=with_tables("runs", f"""
SELECT run_id, {NOW_MS} - 5 * {DAY} + s * 3600000 + 7200000 AS due_ms FROM runs JOIN (SELECT 'w' || s AS worker, s FROM range(0, 20) t(s) WHERE s % 3 = 0) USING (worker)
WHERE state IN ('claimed', 'running') AND {NOW_MS} - 5 * {DAY} + s * 3600000 + 7200000 <= {NOW_MS} - 4 * {DAY} - 43200000"""))  # fmt: skip
def loss_overdue(spark, sf_dir):
    """Runs of workers silent for two hours."""
    silent = spark.range(20).where("id % 3 = 0").select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("worker"), (F.lit(NOW_MS - 5 * DAY) + F.col("id") * 3600000).alias("silent_from_ms"))
    return sched.overdue(runs(spark, sf_dir), silent, 7_200_000, NOW_MS - 4 * DAY - 43_200_000).select("run_id", "due_ms")


_LOSS = """
, w AS (SELECT DISTINCT definition, coalescing_key FROM runs WHERE state = 'queued' AND task_id % 7 = 1),
l AS (SELECT r.*, CASE WHEN non_retriable AND NOT ephemeral AND state = 'running' THEN 'orphaned' ELSE 'lost' END AS becomes, w.definition IS NOT NULL AS waits FROM runs r LEFT JOIN w USING (definition, coalescing_key) WHERE state IN ('claimed', 'running'))
SELECT run_id, becomes, NOT (becomes = 'orphaned' OR ephemeral OR waits) AS replayed FROM l"""


@query("B21", "F3", sql=with_tables("runs", _LOSS).replace(") \n, w AS", "), w AS"))
def loss_outcome(spark, sf_dir):
    """What becomes of runs whose worker is gone."""
    r = runs(spark, sf_dir)
    return sched.loss_outcome(r.where("state in ('claimed', 'running')"), r.where("state = 'queued' and task_id % 7 = 1")).select("run_id", "becomes", "replayed")


@query("B22", "C12", sql=with_tables("runs", f"""
SELECT run_id FROM runs WHERE state IN ('succeeded', 'failed', 'cancelled') AND updated_ms + coalesce(CASE WHEN task_id % 4 = 0 THEN {2 * DAY} END, {10 * DAY}) <= {NOW_MS} AND (task_id % 40) % 9 <> 0"""))  # fmt: skip
def retention_forget(spark, sf_dir):
    """Finished runs past retention whose composite isn't held."""
    done = runs(spark, sf_dir).where("state in ('succeeded', 'failed', 'cancelled')").withColumns({"finished_ms": F.col("updated_ms"), "ttl_ms": F.when(F.col("task_id") % 4 == 0, F.lit(2 * DAY)), "composite_id": F.col("task_id") % 40})
    held = spark.range(40).where("id % 9 = 0").select(F.col("id").alias("composite_id"))
    return sched.forgettable(done, held, "ttl_ms", 10 * DAY, NOW_MS).select("run_id")


@query("B23", "E21", sql=with_tables("tasks", f"""
SELECT task_id, CASE WHEN submitted_ms + 3600000 <= {NOW_MS - 20 * DAY} THEN 'MigrationError' ELSE 'blocked' END AS verdict FROM tasks
LEFT JOIN (VALUES ('click', 3), ('view', 1), ('error', 4)) v(definition, runnable) USING (definition) WHERE task_id % 6 > runnable"""))  # fmt: skip
def version_blocked(spark, sf_dir):
    """Tasks too new for the workers, skipped and in the end failed; unlisted definitions aren't judged."""
    runnable = spark.createDataFrame([("click", 3), ("view", 1), ("error", 4)], "definition string, runnable_version int")
    df = tasks(spark, sf_dir).withColumn("source_version", F.col("task_id") % 6)
    return sched.blocked(df, runnable, 3_600_000, NOW_MS - 20 * DAY).select("task_id", "verdict")


@query("B27", sql=with_tables("tasks", "SELECT queue, least(min(submitted_ms + delay_ms), min(submitted_ms + expiry_ms)) AS deadline FROM tasks GROUP BY queue"))
def next_deadline(spark, sf_dir):
    """The earliest of several kinds of deadlines of each queue."""
    return tasks(spark, sf_dir).groupBy("queue").agg(F.least(F.min(F.col("submitted_ms") + F.col("delay_ms")), F.min(F.col("submitted_ms") + F.col("expiry_ms"))).alias("deadline"))


@query("B28", sql=with_tables("tasks", """
SELECT task_id, coalesce(CASE WHEN task_id % 3 = 0 THEN 'own-' || queue END, CASE WHEN amount % 2 = 0 THEN 'router-' || definition END, 'default') AS queue FROM tasks WHERE trim(coalesce(CASE WHEN task_id % 3 = 0 THEN 'own-' || queue END, 'x')) <> ''"""))  # fmt: skip
def route_queue(spark, sf_dir):
    """A task's queue: its own, else the router's, else the default; blank names are refused."""
    own = F.when(F.col("task_id") % 3 == 0, F.concat(F.lit("own-"), F.col("queue")))
    routed = F.when(F.col("amount") % 2 == 0, F.concat(F.lit("router-"), F.col("definition")))
    return tasks(spark, sf_dir).where(F.trim(F.coalesce(own, F.lit("x"))) != "").select("task_id", F.coalesce(own, routed, F.lit("default")).alias("queue"))


@query("B29", sql=with_tables("tasks policy", """
SELECT task_id, coalesce(CASE WHEN task_id % 4 = 0 THEN 1000 + task_id END, CASE WHEN priority >= 5 THEN priority * 100 END, 60000)::BIGINT AS timeout_ms, coalesce(CASE WHEN max_retries > 0 THEN max_retries END, weight, 5)::BIGINT AS retries FROM tasks LEFT JOIN policy USING (queue)"""))  # fmt: skip
def settings_precedence(spark, sf_dir):
    """Settings of the task, else of its queue, else of the process."""
    df = tasks(spark, sf_dir).join(F.broadcast(policy(spark)), "queue", "left")  # a row for each queue
    timeout = F.coalesce(F.when(F.col("task_id") % 4 == 0, F.col("task_id") + 1000), F.when(F.col("priority") >= 5, F.col("priority") * 100), F.lit(60000))
    return df.select("task_id", timeout.cast("bigint").alias("timeout_ms"), F.coalesce(F.when(F.col("max_retries") > 0, F.col("max_retries")), F.col("weight"), F.lit(5)).cast("bigint").alias("retries"))


@query("B30", sql=with_tables("runs", """
SELECT task_id, arg_max(run_id, attempt) AS run_id, arg_max(state, attempt) AS state, CASE WHEN arg_max(state, attempt) = 'failed' THEN arg_max(failure_kind, attempt) END AS failure_kind, arg_max(updated_ms, attempt) AS updated_ms
FROM runs GROUP BY task_id HAVING arg_max(state, attempt) IN ('succeeded', 'failed', 'expired', 'superseded', 'cancelled', 'lost', 'orphaned')"""))  # fmt: skip
def conclusions(spark, sf_dir):
    """What clients are told of finished tasks."""
    newest = sched.newest_run(runs(spark, sf_dir)).where(F.col("state").isin(*sched.TERMINAL))
    return newest.select("task_id", "run_id", "state", F.when(F.col("state") == "failed", F.col("failure_kind")).alias("failure_kind"), "updated_ms")


@query("B32", sql=with_tables("runs", f"""
, rec AS (SELECT run_id, worker, state, {NOW_MS} - (task_id % 40) * 1000 AS decided_ms FROM runs WHERE task_id % 5 <> 1), rep AS (SELECT run_id, worker FROM runs WHERE task_id % 3 = 0)
SELECT coalesce(rec.run_id, rep.run_id) AS run_id, coalesce(rec.worker, rep.worker) AS worker, CASE WHEN rec.run_id IS NULL THEN 'rebuilt' WHEN rep.run_id IS NOT NULL AND state IN ('claimed', 'running') THEN 'adopted'
  WHEN rep.run_id IS NOT NULL AND state = 'cancelled' THEN 'tell_cancelled' WHEN rep.run_id IS NULL AND state IN ('claimed', 'running') AND decided_ms + 10000 > {NOW_MS} THEN 'in_flight'
  WHEN rep.run_id IS NULL AND state IN ('claimed', 'running') THEN 'lost' ELSE 'ignored' END AS verdict FROM rec FULL OUTER JOIN rep ON rec.run_id = rep.run_id AND rec.worker = rep.worker""").replace(") \n, rec AS", "), rec AS"))  # fmt: skip
def report_application(spark, sf_dir):
    """A worker's report against the record: adopted, lost, in flight, rebuilt."""
    r = runs(spark, sf_dir)
    recorded = r.where("task_id % 5 <> 1").select("run_id", "worker", "state", (F.lit(NOW_MS) - F.col("task_id") % 40 * 1000).alias("decided_ms"))
    return sched.apply_reports(recorded, r.where("task_id % 3 = 0").select("run_id", "worker"), NOW_MS)


@query("A22", sql=with_tables("runs", """
, n AS (SELECT task_id, arg_max(state, attempt) AS state, max(attempt) AS attempt FROM runs WHERE task_id % 10 <> 7 GROUP BY task_id)
SELECT task_id, CASE WHEN state IS NULL THEN 'unknown' WHEN state IN ('scheduled', 'queued', 'claimed') THEN 'pending' ELSE state END AS status, coalesce(attempt, 0) AS attempt FROM tasks LEFT JOIN n USING (task_id)""").replace(") \n, n AS", "), n AS"))  # fmt: skip
def task_status(spark, sf_dir):
    """Unknown, pending, running or how the newest run ended."""
    newest = sched.newest_run(runs(spark, sf_dir).where("task_id % 10 <> 7")).select("task_id", "state", "attempt")
    return tasks(spark, sf_dir).join(newest, "task_id", "left").select("task_id", sched.status(F.col("state")).alias("status"), F.coalesce("attempt", F.lit(0)).alias("attempt"))


@query("D11", sql=with_tables("runs", f"""
SELECT task_id FROM tasks JOIN (SELECT task_id, arg_max(state, attempt) AS state FROM runs GROUP BY task_id) USING (task_id)
WHERE (expiry_ms IS NULL OR submitted_ms + expiry_ms > {NOW_MS - 15 * DAY}) AND (state = 'queued' OR (state = 'scheduled' AND (delay_ms IS NULL OR submitted_ms + delay_ms <= {NOW_MS - 15 * DAY})))"""))  # fmt: skip
def looks_claimable(spark, sf_dir):
    """Records that look claimable."""
    newest = sched.newest_run(runs(spark, sf_dir)).select("task_id", "state")
    return sched.claimable(tasks(spark, sf_dir).join(newest, "task_id"), NOW_MS - 15 * DAY).select("task_id")


@query("B31", sql=with_tables("tasks", """
SELECT task_id FROM (SELECT task_id, k, refused, sum(refused::BIGINT) OVER (PARTITION BY k ORDER BY submitted_ms, ticket ROWS UNBOUNDED PRECEDING) AS stop
  FROM (SELECT *, CASE WHEN task_id % 10 <> 0 THEN coalescing_key END AS k, bytes > 1080 AS refused FROM tasks)) WHERE (k IS NOT NULL AND stop = 0) OR (k IS NULL AND NOT refused)"""))  # fmt: skip
def backlog_order(spark, sf_dir):
    """Submissions buffered before there was a leader, in order within each key."""
    df = tasks(spark, sf_dir).withColumn("k", F.when(F.col("task_id") % 10 != 0, F.col("coalescing_key")))
    return sched.backlog(df, "k", ["submitted_ms", "ticket"], F.col("bytes") > 1080).select("task_id")
