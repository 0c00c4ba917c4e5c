"""Queries of the composition, reduce and coalescing operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from weftline.functions import bodies, outcomes
from weftline.operators import coalesce, compose, reduce
from weftline.registry import query
from weftline.sources.fixtures import NOW_MS, members, runs, table, tasks, with_tables


def _less_thrice(item: int, previous: int) -> int:
    return int(math.fmod(item - previous * 3, 1000003))


def _flaky(value: int) -> int:
    if value % 5 == 0:
        raise ValueError("five")
    if value % 3 == 0 and bodies.run_info()["try"] == 1:
        raise RuntimeError("the first try")
    return value * 2


@query("A18", "F4", sql=with_tables("tasks", """
SELECT definition, coalescing_key, task_id, submitted_ms, payload, absorbed FROM (
  SELECT *, row_number() OVER (PARTITION BY definition, coalescing_key ORDER BY submitted_ms DESC, ticket DESC) AS n,
         count(*) OVER (PARTITION BY definition, coalescing_key) - 1 AS absorbed FROM tasks) WHERE n = 1"""))  # fmt: skip
def coalesce_latest(spark, sf_dir):
    """The newest pending generation of each key, and how many it absorbed."""
    df = coalesce.latest(tasks(spark, sf_dir), ["definition", "coalescing_key"], ["submitted_ms", "ticket"], ["task_id", "submitted_ms", "payload"])
    return df.select("definition", "coalescing_key", "task_id", "submitted_ms", "payload", "absorbed")


@query("A18", sql=with_tables("tasks", """
SELECT task_id, superseded_by FROM (SELECT task_id, lead(task_id) OVER (PARTITION BY definition, coalescing_key ORDER BY submitted_ms, ticket) AS superseded_by FROM tasks) WHERE superseded_by IS NOT NULL"""))  # fmt: skip
def coalesce_superseded(spark, sf_dir):
    """Each older generation with the next one that replaced it."""
    return coalesce.superseded(tasks(spark, sf_dir), ["definition", "coalescing_key"], ["submitted_ms", "ticket"], "task_id").select("task_id", "superseded_by")


@query("A19", sql=with_tables("tasks", """
SELECT coalescing_key, count(*) AS items, list_reduce(list(amount ORDER BY submitted_ms, ticket), lambda a, x: (a * 31 + x) % 1000003) AS payload FROM tasks GROUP BY coalescing_key"""))  # fmt: skip
def coalesce_merge_fold(spark, sf_dir):
    """Payloads of each key folded oldest to newest by a merge that is not associative."""
    df = coalesce.merge_fold(tasks(spark, sf_dir), ["coalescing_key"], ["submitted_ms", "ticket"], F.col("amount"), lambda a, x: (a * 31 + x) % 1000003)
    return df.select("coalescing_key", "items", "payload")


@query("B16", sql=with_tables("tasks", """
SELECT task_id, coalesce(sum((task_id % 5 = 0)::BIGINT) OVER (PARTITION BY coalescing_key ORDER BY submitted_ms, ticket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS generation FROM tasks"""))  # fmt: skip
def coalesce_generations(spark, sf_dir):
    """Generation of each submission: claims of its key before it."""
    return coalesce.generations(tasks(spark, sf_dir), ["coalescing_key"], ["submitted_ms", "ticket"], F.col("task_id") % 5 == 0).select("task_id", "generation")


@query("B17", sql=with_tables("tasks", """
SELECT coalescing_key, array_to_string(list_concat(list_concat(list_slice(l, 1, len(l) - 2), [list_extract(l, len(l) - 1)]), [list_extract(l, len(l))]), ',') AS chain
FROM (SELECT coalescing_key, list(task_id ORDER BY submitted_ms, ticket) AS l FROM tasks GROUP BY coalescing_key) WHERE len(l) >= 2"""))  # fmt: skip
def release_unrun(spark, sf_dir):
    """A released generation goes into the newer one's chain, with its own chain before it."""
    listed = tasks(spark, sf_dir).groupBy("coalescing_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("submitted_ms", "ticket", "task_id"))), lambda x: x["task_id"]).alias("l")).where("size(l) >= 2")
    chain = coalesce.release_chain(F.slice("l", F.lit(1), F.size("l") - 2), F.get("l", F.size("l") - 2), F.slice("l", F.size("l"), F.lit(1)))
    return listed.select("coalescing_key", F.array_join(F.transform(chain, lambda x: x.cast("string")), ",").alias("chain"))


@query("B24", sql=with_tables("tasks", """
SELECT coalescing_key, task_id FROM (
  SELECT *, count(*) OVER (PARTITION BY coalescing_key) AS n FROM (
    SELECT *, sum(bytes) OVER (PARTITION BY coalescing_key ORDER BY submitted_ms, ticket) AS run, sum(bytes) OVER (PARTITION BY coalescing_key) AS total FROM tasks)
  WHERE run <= 9000 AND total > 4500) WHERE n >= 2"""))  # fmt: skip
def compaction_prefix(spark, sf_dir):
    """Oldest payloads of long chains that fit one claim."""
    return coalesce.compaction_prefix(tasks(spark, sf_dir), ["coalescing_key"], ["submitted_ms", "ticket"], "bytes", 9000, 4500).select("coalescing_key", "task_id")


@query("B25", sql=with_tables("tasks", """
SELECT coalescing_key, bool_and(want IS NULL OR entry = want) AS applies, CASE WHEN bool_and(want IS NULL OR entry = want) THEN count(*) - count(want) + 1 ELSE count(*) END AS length
FROM (SELECT coalescing_key, pos, task_id AS entry, CASE WHEN pos < 3 THEN task_id + (user_n % 4 = 0)::BIGINT END AS want FROM (
  SELECT coalescing_key, task_id, coalescing_key::BIGINT AS user_n, row_number() OVER (PARTITION BY coalescing_key ORDER BY submitted_ms, ticket) - 1 AS pos FROM tasks)) GROUP BY coalescing_key"""))  # fmt: skip
def compaction_apply(spark, sf_dir):
    """Folded prefixes are swapped in only where the chain still starts with them."""
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("coalescing_key").orderBy("submitted_ms", "ticket")) - 1
    chain = tasks(spark, sf_dir).select("coalescing_key", pos.cast("bigint").alias("pos"), F.col("task_id").alias("entry"))
    stale = (F.col("coalescing_key").cast("bigint") % 4 == 0).cast("bigint")
    prefix = chain.where("pos < 3").withColumn("entry", F.col("entry") + stale)
    return coalesce.apply_compaction(chain, prefix, ["coalescing_key"])


@query("B26", sql=with_tables("tasks", """
SELECT task_id FROM (SELECT *, sum(bytes) OVER (PARTITION BY coalescing_key ORDER BY submitted_ms DESC, ticket DESC ROWS UNBOUNDED PRECEDING) AS run FROM tasks) WHERE run <= 5000"""))  # fmt: skip
def drop_oldest(spark, sf_dir):
    """What each key retains under its limit when the oldest payloads are dropped."""
    return coalesce.drop_oldest(tasks(spark, sf_dir), ["coalescing_key"], ["submitted_ms", "ticket"], "bytes", 5000).select("task_id")


@query("A1", "F1", sql="SELECT event_id, upper(event_type) || ':' || length(props) AS result FROM events")
def call_task(spark, sf_dir):
    """One body over each row."""
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.upper("event_type"), F.lit(":"), F.length("props").cast("string")).alias("result"))


@query("A6", sql="""
SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: reverse(w) || length(w)), ' ') AS result FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def map_ordered(spark, sf_dir):
    """A body over each item of a list, in input order, however long the list."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("items"))
    out = compose.map_items(docs, "items", lambda w: F.concat(F.reverse(w), F.length(w).cast("string")))
    return out.select("doc_id", F.array_join("result", " ").alias("result"))


@query("A12", "F5", sql="""
SELECT doc_id, idx - 1 AS idx, line, length(line) AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents)""")  # fmt: skip
def map_expand(spark, sf_dir):
    """A returned list split into one row for each item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("items"))
    return compose.expand(docs, "items", "idx", "line").select("doc_id", F.col("idx").cast("bigint").alias("idx"), "line", F.length("line").cast("bigint").alias("size"))


@query("A7", sql="SELECT event_id, upper(event_type) AS shout, length(event_type) AS size, reverse(event_type) AS back FROM events")
def group_members(spark, sf_dir):
    """Different members over the same input."""
    df = compose.group_members(table(spark, sf_dir, "events"), {"shout": F.upper, "size": lambda c: F.length(c).cast("bigint"), "back": F.reverse}, "event_type")
    return df.select("event_id", "shout", "size", "back")


@query("A10", "A4", sql="SELECT event_id, upper(event_type) AS stage_0, upper(event_type) || '!' AS stage_1, 7::BIGINT AS stage_2, 14::BIGINT AS stage_3 FROM events")
def flow_stages(spark, sf_dir):
    """Stages in sequence, each result kept; a bound stage ignores its predecessor."""
    df = compose.flow(table(spark, sf_dir, "events"), [F.upper, lambda c: F.concat(c, F.lit("!")), F.lit(7).cast("bigint"), lambda c: c * 2], "event_type")
    return df.select("event_id", *(f"stage_{k}" for k in range(4)))


@query("A11", sql="SELECT event_id, upper(event_type) AS outer_0, reverse(upper(event_type)) AS inner_0, length(upper(event_type)) AS inner_1 FROM events")
def nested_steps(spark, sf_dir):
    """A group inside a flow: results nest alike."""
    df = compose.flow(table(spark, sf_dir, "events"), [F.upper, lambda c: F.struct(F.reverse(c).alias("inner_0"), F.length(c).cast("bigint").alias("inner_1"))], "event_type")
    return df.select("event_id", F.col("stage_0").alias("outer_0"), "stage_1.inner_0", "stage_1.inner_1")


@query("A5", sql="SELECT o_orderkey, o_orderstatus AS status, 'HIGH' AS priority, o_custkey + 1 AS customer FROM orders")
def bind_fields(spark, sf_dir):
    """Scalar fields overridden on a copy of the input."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer")).alias("input"))
    return compose.bind_fields(df, "input", priority="HIGH", customer=F.col("input.customer") + 1).select("o_orderkey", "input.*")


@query("A9", sql=with_tables("members", """
SELECT composite_id, string_agg(CASE WHEN state = 'failed' THEN '!ValueError' ELSE value::VARCHAR END, ',' ORDER BY idx) AS entries,
       count(*) FILTER (state = 'failed') AS failures, count(*) FILTER (state <> 'failed') AS "values" FROM members GROUP BY composite_id"""))  # fmt: skip
def collect_all_outcomes(spark, sf_dir):
    """Every member's value or failure, in order."""
    return compose.collect_all(members(spark, sf_dir), ["composite_id"], F.col("state") == "failed", F.col("value"), F.lit("ValueError"), "idx")


@query("A9", sql=with_tables("members", """
SELECT composite_id, row_number() OVER (PARTITION BY composite_id ORDER BY idx) - 1 AS place, state <> 'failed' AS ok, CASE WHEN state <> 'failed' THEN value END AS value,
       CASE WHEN state = 'failed' THEN 'ValueError' END AS kind, CASE WHEN state = 'failed' THEN 'size ' || size END AS message FROM members"""))  # fmt: skip
def collect_all_entries(spark, sf_dir):
    """Every member's value, or its failure's kind and message, in order."""
    out = compose.collect_entries(members(spark, sf_dir), ["composite_id"], F.col("state") == "failed", F.col("value"), F.lit("ValueError"), F.concat(F.lit("size "), F.col("size").cast("string")), "idx")
    rows = out.select("composite_id", F.posexplode("entries").alias("place", "e"))
    return rows.select("composite_id", F.col("place").cast("bigint").alias("place"), "e.ok", "e.value", "e.failure.kind", "e.failure.message")


@query("A8", sql=with_tables("members", """
SELECT composite_id, count(*) AS members, CASE WHEN count(*) FILTER (state = 'failed') > 0 THEN 'failed' ELSE 'succeeded' END AS state,
       min(idx) FILTER (state = 'failed') AS failed_index, CASE WHEN count(*) FILTER (state = 'failed') > 0 THEN 'size ' || arg_min(size, idx) FILTER (state = 'failed') END AS failure_kind
FROM members GROUP BY composite_id"""))  # fmt: skip
def fail_fast_first(spark, sf_dir):
    """A composite fails by its failing member of the lowest index."""
    return compose.fail_fast(members(spark, sf_dir), ["composite_id"], F.col("state") == "failed", "idx", F.concat(F.lit("size "), F.col("size").cast("string")))


@query("A9", "F6", sql="SELECT event_id, stage_0, CASE WHEN stage_0 IS NOT NULL THEN stage_0 * 2 END AS stage_1, stage_0 IS NULL AS stopped FROM (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN user_id + 1 END AS stage_0 FROM events)")
def flow_failure_stops(spark, sf_dir):
    """A failed stage stops the stages after it."""
    start = outcomes.outcome(F.col("user_id"), F.lit(False), F.lit(""))
    first = lambda v: outcomes.outcome(v + 1, v % 3 == 0, F.lit("ValueError"))
    df = compose.flow_outcomes(table(spark, sf_dir, "events"), [first, lambda v: outcomes.outcome(v * 2, F.lit(False), F.lit(""))], start)
    return df.select("event_id", F.col("stage_0.value").alias("stage_0"), F.col("stage_1.value").alias("stage_1"), F.col("stage_1").isNull().alias("stopped"))


@query("A3", sql=with_tables("tasks", """
SELECT task_id, ceil((task_id % 1000) / 7.0 * 1000)::BIGINT AS delay_ms, (task_id % 1000) * 3 + 1 AS expires_s, ceil((task_id % 1000) / 7.0 * 1000)::BIGINT < ((task_id % 1000) * 3 + 1) * 1000 AS valid,
       submitted_ms + ceil((task_id % 1000) / 7.0 * 1000)::BIGINT AS due_ms FROM tasks"""))  # fmt: skip
def option_millis(spark, sf_dir):
    """Delays rounded up to milliseconds, and whether the expiry lies beyond."""
    n = F.col("task_id") % 1000
    delay = outcomes.millis_up(n / F.lit(7.0), 1000)
    expires = n * 3 + 1
    return tasks(spark, sf_dir).select("task_id", delay.alias("delay_ms"), expires.alias("expires_s"), (delay < expires * 1000).alias("valid"), (F.col("submitted_ms") + delay).alias("due_ms"))


@query("A3", sql=with_tables("tasks", f"""
, o AS (SELECT task_id, CASE WHEN task_id % 3 = 0 THEN task_id % 1000 END AS delay_s, CASE WHEN task_id % 5 = 0 THEN submitted_ms END AS eta_ms, CASE WHEN task_id % 4 <> 1 THEN task_id % 700 - 20 END AS expires_s FROM tasks),
d AS (SELECT *, CASE WHEN delay_s IS NOT NULL THEN delay_s * 1000 WHEN eta_ms IS NOT NULL THEN greatest(eta_ms - {NOW_MS}, 0) END AS delay_ms FROM o)
SELECT task_id, CASE WHEN refused IS NULL THEN delay_ms END AS delay_ms, CASE WHEN refused IS NULL THEN expires_s * 1000 END AS expires_in_ms, refused FROM (SELECT *, CASE WHEN delay_s IS NOT NULL AND eta_ms IS NOT NULL THEN 'delay_and_eta'
  WHEN expires_s < 0 THEN 'negative' WHEN delay_ms > 0 AND expires_s * 1000 <= delay_ms THEN 'expires_first' END AS refused FROM d)""").replace(") \n, o AS", "), o AS"))  # fmt: skip
def call_options(spark, sf_dir):
    """Delay or eta, and expiry, of each call, or why its options are refused."""
    n = F.col("task_id")
    options = outcomes.call_options(F.when(n % 3 == 0, n % 1000), F.when(n % 5 == 0, F.col("submitted_ms")), F.when(n % 4 != 1, n % 700 - 20), NOW_MS)
    return tasks(spark, sf_dir).select("task_id", options.alias("o")).select("task_id", "o.*")


@query("A1", "F1", "F6", "F8", sql=with_tables("tasks", """
SELECT task_id, task_id % 5 <> 0 AS ok, CASE WHEN task_id % 5 <> 0 THEN task_id * 2 END AS value, CASE WHEN task_id % 5 = 0 THEN 'ValueError' END AS failure_kind,
       CASE WHEN task_id % 5 = 0 THEN 'five' END AS failure_message, CASE WHEN task_id % 5 = 0 THEN 3 WHEN task_id % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM tasks"""))  # fmt: skip
def task_outcomes(spark, sf_dir):
    """A user's body over each row: its value or failure, tried again where it failed."""
    out = bodies.run(tasks(spark, sf_dir).select("task_id"), bodies.task("bigint", retries=2)(_flaky), "task_id")
    return out.select("task_id", "outcome.*")


@query("A13", "F2", sql=with_tables("members", """
SELECT composite_id, count(*) AS items, list_reduce(list(value ORDER BY idx), lambda a, x: (x - a * 3) % 1000003) AS result FROM members GROUP BY composite_id"""))  # fmt: skip
def reduce_chain(spark, sf_dir):
    """Left fold of a reducer that is not associative."""
    return reduce.chain(members(spark, sf_dir), ["composite_id"], ["idx"], F.col("value"), lambda a, x: (x - a * 3) % 1000003)


@query("A13", "A17", "F2", sql=with_tables("members", """
SELECT composite_id, count(*) AS items, list_reduce(list(value ORDER BY idx), lambda a, x: (x - a * 3) % 1000003) AS result FROM members GROUP BY composite_id"""))  # fmt: skip
def reduce_declared(spark, sf_dir):
    """A declared reducer of Python over each composite's values."""
    return bodies.reduce(members(spark, sf_dir), ["composite_id"], "idx", "value", bodies.reducer("bigint")(_less_thrice))


@query("A14", "A16", sql=with_tables("members", """
SELECT composite_id, count(*) AS items, ceil(count(*) / 4.0)::BIGINT AS chunks, 2 * ceil(count(*) / 4.0)::BIGINT - 1 AS steps, string_agg(value::VARCHAR, '' ORDER BY idx) AS result FROM members GROUP BY composite_id"""))  # fmt: skip
def reduce_tree_concat(spark, sf_dir):
    """Chunks folded side by side, then together, in order."""
    return reduce.tree(members(spark, sf_dir), ["composite_id"], "idx", F.col("value").cast("string"), lambda a, x: F.concat(a, x), chunk=4)


@query("A15", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE 100 + list_sum(generate_series(1, o_orderkey % 4)) END::BIGINT AS seeded,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE list_sum(generate_series(1, o_orderkey % 4)) END::BIGINT AS seedless FROM orders""")  # fmt: skip
def reduce_edges(spark, sf_dir):
    """Empty lists give the seed; single items are themselves."""
    n = F.col("o_orderkey") % 4
    items = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1))))
    df = table(spark, sf_dir, "orders").select("o_orderkey", items.alias("items"))
    add = lambda a, x: a + x
    seedless = F.when(F.size("items") > 0, reduce.guarded(F.col("items"), add, None))
    return df.select("o_orderkey", reduce.guarded(F.col("items"), add, F.lit(100).cast("bigint")).alias("seeded"), seedless.alias("seedless"))


@query("A14", "C9", sql=with_tables("members", """
SELECT composite_id, l.level::BIGINT AS level, unnest(generate_series(0, ceil(width / (2.0 ** l.level))::BIGINT - 1)) AS slot
FROM (SELECT composite_id, ceil(count(*) / 2.0) AS width FROM members GROUP BY composite_id) p, generate_series(0, 20) l(level) WHERE l.level <= ceil(log2(width))"""))  # fmt: skip
def reduce_plan_steps(spark, sf_dir):
    """Nodes of each composite's reduce tree, from its item count alone."""
    counted = members(spark, sf_dir).groupBy("composite_id").agg(F.count("*").alias("items"))
    return reduce.tree_plan(counted, "items", 2).select("composite_id", "level", "slot")


@query("C9", sql=with_tables("members", """
WITH p AS (SELECT composite_id, ceil(count(*) / 2.0)::BIGINT AS width FROM members GROUP BY composite_id)
SELECT composite_id, s.slot AS slot FROM p, generate_series(0, 20) s(slot) WHERE width > 1 AND s.slot < ceil(width / 2.0)
  AND (2 * s.slot) % 3 <> 2 AND (2 * s.slot + 1 >= width OR (2 * s.slot + 1) % 3 <> 2)""".replace("WITH p AS", "p AS", 1)).replace(") \np AS", "), p AS", 1))  # fmt: skip
def reduce_startable(spark, sf_dir):
    """Reduce steps whose operands are all settled."""
    counted = members(spark, sf_dir).groupBy("composite_id").agg(F.count("*").alias("items"))
    plan = reduce.tree_plan(counted, "items", 2).select("composite_id", "level", "slot")
    settled = plan.where("level = 0 and slot % 3 <> 2")
    return reduce.startable(plan, settled, ["composite_id"]).select("composite_id", "slot")


@query("A16", sql="""
SELECT doc_id, count(*) AS items, sum(length(word))::BIGINT AS result FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY doc_id""")  # fmt: skip
def reduce_after_map(spark, sf_dir):
    """A reduce that folds a map's rows directly: expansion, body and fold in one plan."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("items"))
    words = compose.expand(docs, "items", "idx", "word").select("doc_id", F.length("word").alias("n"))
    return words.groupBy("doc_id").agg(F.count("*").alias("items"), F.sum("n").alias("result"))


@query("F8", "B18", sql=with_tables("runs", "SELECT task_id, max(attempt) AS attempts, count(*) FILTER (state IN ('failed', 'lost')) AS ended_badly FROM runs GROUP BY task_id"))
def run_attempts(spark, sf_dir):
    """Attempts of each task."""
    return runs(spark, sf_dir).groupBy("task_id").agg(F.max("attempt").alias("attempts"), F.count_if(F.col("state").isin("failed", "lost")).alias("ended_badly"))


@query("A20", "A11", sql="""
SELECT event_id, CASE event_type WHEN 'view' THEN '{"r":{"s0":"VIEW","s1":4}}' WHEN 'click' THEN '{"r":{"m0":"CLICK","m1":"kcilc"}}' WHEN 'error' THEN '{"r":9}' END AS result FROM events""")  # fmt: skip
def continuations(spark, sf_dir):
    """Bodies that return a flow, a group or a bound task, which runs next."""
    from weftline.plans.continuation import continued
    from weftline.plans.tree import Task, flow, group

    shout, size, back = Task(F.upper), Task(F.length), Task(F.reverse)
    plans = {"view": flow(shout, size), "click": group(shout, back), "error": Task(lambda c: c + 2).bind(7)}
    return continued(table(spark, sf_dir, "events"), F.col("event_type"), plans, "event_type").select("event_id", "result")
