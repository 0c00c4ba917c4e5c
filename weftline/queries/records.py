"""Queries of the replicated-record operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import records as rec
from weftline.operators import scheduling as sched
from weftline.registry import query
from weftline.sources.fixtures import NOW_MS, reported, runs, table, tasks, voters, with_tables

_HASH = "CAST('0x' || left(sha256({}::VARCHAR), 15) AS BIGINT)"


@query("D1", sql=with_tables("reported", """
SELECT record_key, epoch, revision, report_id, content, revisions FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY epoch DESC, revision DESC, report_id DESC) AS n, count(*) OVER (PARTITION BY record_key) AS revisions FROM reported) WHERE n = 1"""))  # fmt: skip
def record_lww(spark, sf_dir):
    """The newest revision of each record."""
    return rec.last_writer_wins(reported(spark, sf_dir), "record_key", ["epoch", "revision", "report_id"], ["content"])


@query("D1", sql=with_tables("reported", """
SELECT report_id, CASE WHEN held IS NULL OR v > held THEN 'stored' WHEN v < held THEN 'older' WHEN content = first THEN 'unchanged' ELSE 'conflicting' END AS put FROM (
  SELECT *, max(v) OVER (PARTITION BY record_key ORDER BY report_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held,
         first_value(content) OVER (PARTITION BY record_key, v ORDER BY report_id) AS first FROM (SELECT *, epoch * 1000 + revision // 10 AS v FROM reported))"""))  # fmt: skip
def record_put_class(spark, sf_dir):
    """What each put does: stored, unchanged, older, conflicting."""
    df = reported(spark, sf_dir).withColumn("revision", F.expr("revision div 10"))
    return rec.put_class(df, "record_key", ["epoch", "revision"], "report_id", "content").select("report_id", "put")


@query("D2", sql=with_tables("reported", """
SELECT record_key, coalesce(max(v) FILTER (holder % 4 = 0 AND report_id % 9 = 0), max(v)) // 1000 AS epoch, coalesce(max(v) FILTER (holder % 4 = 0 AND report_id % 9 = 0), max(v)) % 1000 AS revision,
       max(v) FILTER (holder % 4 = 0 AND report_id % 9 = 0) IS NOT NULL AS reachable FROM (SELECT *, epoch * 1000 + revision AS v FROM reported) GROUP BY record_key"""))  # fmt: skip
def newest_reachable(spark, sf_dir):
    """The newest version that a member still holds."""
    return rec.newest_reachable(reported(spark, sf_dir), "record_key", ["epoch", "revision"], (F.col("holder") % 4 == 0) & (F.col("report_id") % 9 == 0))


_PLACED = f"""
, k AS (SELECT DISTINCT record_key FROM reported),
p AS (SELECT record_key, worker, row_number() OVER (PARTITION BY record_key ORDER BY xor({_HASH.format('record_key')}, {_HASH.format('worker')}), worker) AS rank FROM k CROSS JOIN voters)"""


def _sql(names: str, text: str) -> str:
    return with_tables(names, text).replace(") \n, ", "), ")


def _keys(spark, sf_dir):
    return reported(spark, sf_dir).select("record_key").distinct()


@query("D6", sql=_sql("reported voters", _PLACED + " SELECT record_key, 2::BIGINT AS quorum, rank, worker FROM p WHERE rank <= 3"))
def xor_placement(spark, sf_dir):
    """The three workers nearest to each record by XOR distance."""
    return rec.placement(_keys(spark, sf_dir), "record_key", voters(spark, sf_dir))


@query("D3", "D5", sql=_sql("reported voters", _PLACED + """
SELECT record_key, count(*) AS placed, count(*) FILTER (answered) AS heard, count(*) FILTER (answered) > count(*) - (count(*) // 2 + 1) OR bool_and(NOT is_member OR answered) AS certain FROM p JOIN voters USING (worker) WHERE rank <= 3 GROUP BY record_key"""))  # fmt: skip
def record_certain(spark, sf_dir):
    """Whether enough holders answered."""
    v = voters(spark, sf_dir)
    return rec.certain(rec.placement(_keys(spark, sf_dir), "record_key", v), v.drop("generation"), "record_key")


@query("D4", sql=with_tables("reported", """
, n AS (SELECT record_key, max(epoch * 1000 + revision) AS v FROM reported GROUP BY ALL)
SELECT record_key, v // 1000 AS epoch, v % 1000 AS revision FROM n WHERE NOT EXISTS (SELECT 1 FROM reported r WHERE r.record_key = n.record_key AND r.epoch * 1000 + r.revision = v AND r.holder % 3 = 0)""").replace(") \n, n AS", "), n AS"))  # fmt: skip
def missing_records(spark, sf_dir):
    """Records whose newest reported version isn't held."""
    df = reported(spark, sf_dir)
    return rec.missing(df, df.where("holder % 3 = 0"), "record_key", ["epoch", "revision"])


@query("D5", sql=with_tables("reported", "SELECT record_key, holder, report_id FROM (SELECT *, row_number() OVER (PARTITION BY record_key, holder ORDER BY epoch DESC, revision DESC, report_id DESC) AS n FROM reported) WHERE n = 1"))
def report_dedup(spark, sf_dir):
    """The newest word of each holder on a record."""
    df = reported(spark, sf_dir).withColumn("run", F.struct("record_key", "holder"))
    return rec.one_report(df, "run", ["epoch", "revision", "report_id"]).select("record_key", "holder", "report_id")


@query("D7", sql=_sql("reported voters", _PLACED + f""",
q AS (SELECT record_key, worker, row_number() OVER (PARTITION BY record_key ORDER BY xor({_HASH.format('record_key')}, {_HASH.format('worker')}), worker) AS rank FROM k CROSS JOIN (SELECT * FROM voters WHERE worker <> 3)),
b AS (SELECT coalesce(p.record_key, q.record_key) AS record_key, p.worker AS a, q.worker AS b FROM (SELECT * FROM p WHERE rank <= 3) p FULL OUTER JOIN (SELECT * FROM q WHERE rank <= 3) q ON p.record_key = q.record_key AND p.worker = q.worker)
SELECT record_key, count(*) FILTER (b IS NULL) AS lost, count(*) FILTER (a IS NULL) AS gained FROM b GROUP BY record_key HAVING count(*) FILTER (b IS NULL) + count(*) FILTER (a IS NULL) > 0"""))  # fmt: skip
def placement_moved(spark, sf_dir):
    """Records to repair after a voter left."""
    v = voters(spark, sf_dir)
    return rec.moved(_keys(spark, sf_dir), "record_key", v, v.where("worker <> 3"))


@query("D7", sql=_sql("reported voters", _PLACED + f""",
q AS (SELECT record_key, worker, row_number() OVER (PARTITION BY record_key ORDER BY xor({_HASH.format('record_key')}, {_HASH.format('worker')}), worker) AS rank FROM k CROSS JOIN (SELECT * FROM voters WHERE worker <> 3)),
b AS (SELECT coalesce(p.record_key, q.record_key) AS record_key, p.worker AS a, q.worker AS b FROM (SELECT * FROM p WHERE rank <= 3) p FULL OUTER JOIN (SELECT * FROM q WHERE rank <= 3) q ON p.record_key = q.record_key AND p.worker = q.worker),
m AS (SELECT record_key, count(*) FILTER (b IS NULL) AS lost, count(*) FILTER (a IS NULL) AS gained FROM b GROUP BY record_key HAVING count(*) FILTER (b IS NULL) + count(*) FILTER (a IS NULL) > 0),
i AS (SELECT DISTINCT record_key FROM reported WHERE finished AND epoch = 2 AND revision > 90)
SELECT record_key FROM m WHERE record_key NOT IN (SELECT record_key FROM i) ORDER BY record_key LIMIT greatest(0, 100 - (SELECT count(*) FROM i))"""))  # fmt: skip
def repair_batch(spark, sf_dir):
    """The next records to repair after a voter left, with at most 100 in flight."""
    v = voters(spark, sf_dir)
    in_flight = reported(spark, sf_dir).where("finished and epoch = 2 and revision > 90")
    return rec.repair_next(rec.moved(_keys(spark, sf_dir), "record_key", v, v.where("worker <> 3")), in_flight, "record_key", 100)


@query("D8", sql=_sql("reported voters", _PLACED + f""",
q AS (SELECT record_key, worker, row_number() OVER (PARTITION BY record_key ORDER BY xor({_HASH.format('record_key')}, {_HASH.format('worker')}), worker) AS rank FROM k CROSS JOIN (SELECT * FROM voters WHERE worker <> 3)),
u AS (SELECT record_key, 0 AS side, worker FROM p WHERE rank <= 3 UNION ALL SELECT record_key, 1, worker FROM q WHERE rank <= 3),
s AS (SELECT record_key, side, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM reported r WHERE r.record_key = u.record_key AND r.holder = u.worker AND r.report_id % 5 = 0)) AS k FROM u GROUP BY ALL)
SELECT record_key, bool_and(k >= n // 2 + 1) AS durable, sum(k)::BIGINT AS copies FROM s GROUP BY record_key"""))  # fmt: skip
def joint_write_quorum(spark, sf_dir):
    """Writes that a quorum of the old and of the new placement stored."""
    v, k = voters(spark, sf_dir), _keys(spark, sf_dir)
    placed = rec.placement(k, "record_key", v).select("record_key", F.lit(0).alias("side"), "worker").unionByName(rec.placement(k, "record_key", v.where("worker <> 3")).select("record_key", F.lit(1).alias("side"), "worker"))
    stored = reported(spark, sf_dir).where("report_id % 5 = 0").select("record_key", F.col("holder").alias("worker")).distinct()
    return rec.joint_quorum(placed, stored, ["record_key"])


@query("D9", sql=with_tables("reported", "SELECT record_key, count(*) AS writes FROM reported GROUP BY record_key HAVING bool_and(report_id % 173 <> 0)"))
def effect_gate(spark, sf_dir):
    """Answers all of whose writes are stored."""
    return rec.released_effects(reported(spark, sf_dir), "record_key", F.col("report_id") % 173 != 0)


@query("D10", sql=with_tables("tasks", """
, c AS (SELECT task_id, lead(task_id) OVER (PARTITION BY definition, coalescing_key ORDER BY submitted_ms, ticket) AS successor FROM tasks)
SELECT task_id, successor FROM c WHERE successor IS NOT NULL AND successor % 3 <> 0""").replace(") \n, c AS", "), c AS"))  # fmt: skip
def write_order(spark, sf_dir):
    """Superseded rows whose successor is stored."""
    from weftline.operators.coalesce import superseded

    older = superseded(tasks(spark, sf_dir), ["definition", "coalescing_key"], ["submitted_ms", "ticket"], "task_id").select("task_id", F.col("superseded_by").alias("successor"))
    rows = tasks(spark, sf_dir).select("task_id", (F.col("task_id") % 3 != 0).alias("stored")).join(older, "task_id", "left")
    return rec.write_after(rows, "successor", "stored").select("task_id", "successor")


@query("D12", sql=with_tables("tasks policy", f"SELECT task_id, rank, distance FROM (SELECT task_id, priority AS rank, xor({_HASH.format('task_id')}, {_HASH.format(chr(39) + 'w7' + chr(39))}) AS distance, submitted_ms FROM tasks JOIN policy USING (queue)) ORDER BY rank DESC, distance, submitted_ms, task_id LIMIT 300"))
def candidate_ranking(spark, sf_dir):
    """Candidates by rank, distance and age."""
    from weftline.sources.fixtures import policy

    df = tasks(spark, sf_dir).join(F.broadcast(policy(spark)), "queue").withColumn("rank", F.col("priority"))  # a row for each queue
    return rec.ranked_candidates(df, "task_id", "w7", 300).select("task_id", "rank", "distance")


@query("D13", sql=with_tables("tasks", """
, s AS (SELECT task_id, submitted_ms, 0 AS stage FROM tasks WHERE task_id % 50 = 0 UNION ALL SELECT task_id, submitted_ms, 1 FROM tasks WHERE queue = 'error' AND task_id % 5 = 0 UNION ALL SELECT task_id, submitted_ms, 2 FROM tasks)
SELECT task_id, min(stage) AS stage FROM s GROUP BY task_id ORDER BY min(stage), any_value(submitted_ms), task_id LIMIT 900""").replace(") \n, s AS", "), s AS"))  # fmt: skip
def staged_discovery(spark, sf_dir):
    """Own records, then peers', then the leader's oldest, each tried once."""
    df = tasks(spark, sf_dir).select("task_id", "submitted_ms", "queue")
    stages = [df.where("task_id % 50 = 0"), df.where("queue = 'error' and task_id % 5 = 0"), df]
    return rec.staged_discovery([s.select("task_id", "submitted_ms") for s in stages], "task_id", ["submitted_ms"], 900).select("task_id", "stage")


@query("D14", sql=with_tables("tasks", "SELECT task_id, queue = 'error' AS urgent FROM tasks WHERE ephemeral ORDER BY urgent DESC, submitted_ms, task_id LIMIT 256"))
def steal_answer(spark, sf_dir):
    """At most 256 ids for a worker that looks for work."""
    return rec.steal(tasks(spark, sf_dir).where("ephemeral"), F.col("queue") == "error").select("task_id", "urgent")


@query("D15", sql=with_tables("runs", "SELECT task_id, attempt, run_id FROM runs WHERE (task_id, attempt) > (500, 1) ORDER BY task_id, attempt LIMIT 250"))
def keyset_page(spark, sf_dir):
    """The page after a key."""
    return rec.page_after(runs(spark, sf_dir), ["task_id", "attempt"], (500, 1), 250).select("task_id", "attempt", "run_id")


@query("D16", sql=with_tables("reported", """
SELECT record_key, sha256(string_agg(len(h) || ':' || h, '' ORDER BY h)) AS digest, count(*) AS members FROM (SELECT DISTINCT record_key, holder::VARCHAR AS h FROM reported) GROUP BY record_key"""))  # fmt: skip
def set_digest(spark, sf_dir):
    """A digest of the holders of each record."""
    return rec.set_digest(reported(spark, sf_dir), ["record_key"], "holder")


@query("D17", sql=with_tables("reported", """
SELECT holder, count(*) AS beats, min(report_id) AS from_beat, max(report_id) AS to_beat FROM (
  SELECT *, sum((content NOT IN ('error', 'view'))::BIGINT) OVER (PARTITION BY holder ORDER BY report_id) AS island FROM reported) WHERE content IN ('error', 'view') GROUP BY holder, island HAVING count(*) >= 2"""))  # fmt: skip
def drift_watch(spark, sf_dir):
    """Disagreements that last two heartbeats and more."""
    return rec.lasting_drift(reported(spark, sf_dir), ["holder"], "report_id", F.col("content").isin("error", "view"))


@query("D17", sql=with_tables("reported", """
, b AS (SELECT holder, report_id AS at_, content IN ('error', 'view') AS bad, row_number() OVER (PARTITION BY holder ORDER BY report_id) AS n FROM reported),
f AS (SELECT DISTINCT holder, 0::BIGINT AS n, NULL::BIGINT AS at_, NULL::BIGINT AS since, NULL::BIGINT AS asked, false AS due FROM b
  UNION ALL SELECT holder, n, at_, since, CASE WHEN due THEN at_ ELSE asked END, due FROM (
    SELECT b.holder, b.n, b.at_, CASE WHEN bad THEN coalesce(since, b.at_) END AS since, asked, bad AND b.at_ - coalesce(since, b.at_) >= 24 AND (asked IS NULL OR b.at_ - asked >= 120) AS due
    FROM f JOIN b ON b.holder = f.holder AND b.n = f.n + 1))
SELECT holder, at_ AS report_id FROM f WHERE due""").replace(") \n, b AS", "), b AS").replace("WITH reported", "WITH RECURSIVE reported"))  # fmt: skip
def drift_asked(spark, sf_dir):
    """When workers whose word differs for long are asked again, not too often."""
    beats = reported(spark, sf_dir).select("holder", "report_id", F.col("content").isin("error", "view").alias("differs"))
    return rec.drift_asks(beats, ["holder"], "report_id", "differs", 24, 120).select("holder", "report_id")


@query("D13", sql=with_tables("tasks", """
, b AS (SELECT task_id, bytes, row_number() OVER (ORDER BY submitted_ms, task_id) AS n FROM tasks),
f AS (SELECT 0::BIGINT AS n, 0::BIGINT AS found, 50000::BIGINT AS room, NULL::BIGINT AS task_id
  UNION ALL SELECT min(b.n), f.found + 1, f.room - arg_min(b.bytes, b.n), arg_min(b.task_id, b.n) FROM f JOIN b ON b.n > f.n AND b.bytes <= f.room WHERE f.found < 90 GROUP BY f.found, f.room)
SELECT task_id FROM f WHERE found > 0""").replace(") \n, b AS", "), b AS").replace("WITH tasks", "WITH RECURSIVE tasks"))  # fmt: skip
def discovery_room(spark, sf_dir):
    """What a claimant takes, oldest first, while its room lasts: a report of top candidates."""
    df = tasks(spark, sf_dir)
    return rec.discovery_in_room(df, "task_id", ["submitted_ms"], "bytes", 50_000, 90)


@query("D18", "D5", "B15", sql=_sql("reported voters", _PLACED + """,
w AS (SELECT record_key, holder, max(epoch * 1000 + revision) AS v, arg_max(finished, (epoch * 1000 + revision) * 1000000000000 + report_id) AS finished FROM reported GROUP BY record_key, holder),
n AS (SELECT *, max(v) OVER (PARTITION BY record_key) AS top FROM w),
s AS (SELECT record_key, top // 1000 AS epoch, top % 1000 AS revision, count(*) FILTER (v = top) AS holders, bool_or(finished AND v = top) AS finished, bool_or(finished) AND NOT bool_or(finished AND v = top) AS illegal FROM n GROUP BY record_key, top),
c AS (SELECT record_key, count(*) FILTER (answered) > count(*) - (count(*) // 2 + 1) OR bool_and(NOT is_member OR answered) AS certain FROM p JOIN voters USING (worker) WHERE rank <= 3 GROUP BY record_key)
SELECT s.*, certain FROM s JOIN c USING (record_key)"""))  # fmt: skip
def rebuild_records(spark, sf_dir):
    """A new leader's records: holders' newest words, the newest version, certainty, and what has gone back illegally."""
    return rec.rebuild(reported(spark, sf_dir), voters(spark, sf_dir).drop("generation"), "record_key", "holder", ["epoch", "revision"], "report_id")


@query("D18", "D20", sql=_sql("reported voters", _PLACED + """,
n AS (SELECT record_key, max(epoch * 1000 + revision) AS v, bool_or(finished) AS finished FROM reported GROUP BY ALL),
c AS (SELECT record_key, count(*) FILTER (answered) > count(*) - (count(*) // 2 + 1) OR bool_and(NOT is_member OR answered) AS certain FROM p JOIN voters USING (worker) WHERE rank <= 3 GROUP BY record_key)
SELECT record_key, v // 1000 AS epoch, v % 1000 AS revision, finished, certain FROM n JOIN c USING (record_key)"""))  # fmt: skip
def rebuild_state(spark, sf_dir):
    """Reports folded into stubs: newest version, whether finished, whether certain."""
    v, df = voters(spark, sf_dir), reported(spark, sf_dir)
    newest = df.groupBy("record_key").agg(F.max(F.struct("epoch", "revision")).alias("v"), F.bool_or("finished").alias("finished")).select("record_key", "v.*", "finished")
    sure = rec.certain(rec.placement(_keys(spark, sf_dir), "record_key", v), v.drop("generation"), "record_key")
    return newest.join(sure.select("record_key", "certain"), "record_key")


@query("D19", sql=with_tables("runs", """
, n AS (SELECT task_id, arg_max(state, attempt) AS state, any_value(coalescing_key) AS coalescing_key FROM runs GROUP BY task_id)
SELECT coalescing_key, max(task_id) FILTER (state IN ('scheduled', 'queued')) AS waiting, max(task_id) FILTER (state IN ('claimed', 'running')) AS holder FROM n GROUP BY coalescing_key""").replace(") \n, n AS", "), n AS"))  # fmt: skip
def waiting_and_holder(spark, sf_dir):
    """The waiting and the held generation of each key."""
    newest = sched.newest_run(runs(spark, sf_dir)).withColumn("at", F.col("task_id"))
    return rec.waiting_and_holder(newest, ["coalescing_key"], "at")


@query("D22", sql=_sql("reported voters", _PLACED + " SELECT record_key, worker FROM p WHERE rank <= 3 AND worker <> 5"))
def drain_hand_off(spark, sf_dir):
    """To whom a draining worker hands its records."""
    return rec.hand_off(_keys(spark, sf_dir), "record_key", voters(spark, sf_dir), 5).select("record_key", "worker")


@query("D23", sql=_sql("reported voters", """
, s AS (SELECT 0 AS side, worker, generation AS admitted, 0 AS low, 2 AS high FROM voters UNION ALL SELECT 1, worker, generation, 1, 3 FROM voters),
e AS (SELECT * FROM s WHERE admitted BETWEEN low AND high), t AS (SELECT side, count(*) AS voters FROM e GROUP BY side),
v AS (SELECT DISTINCT record_key AS ballot, holder AS worker FROM reported),
c AS (SELECT b.ballot, t.side, t.voters, (SELECT count(*) FROM v JOIN e USING (worker) WHERE v.ballot = b.ballot AND e.side = t.side) AS counted FROM (SELECT DISTINCT ballot FROM v) b CROSS JOIN t)
SELECT ballot, sum(counted)::BIGINT AS counted, bool_and(2 * counted > voters) AS passed FROM c GROUP BY ballot"""))  # fmt: skip
def quorum_tally(spark, sf_dir):
    """Ballots that have a majority of both configurations."""
    v = voters(spark, sf_dir)
    side = lambda n, low, high: v.select(F.lit(n).alias("side"), "worker", F.col("generation").alias("admitted"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    votes = reported(spark, sf_dir).select(F.col("record_key").alias("ballot"), F.col("holder").alias("worker"))
    return rec.quorum_tally(votes, side(0, 0, 2).unionByName(side(1, 1, 3)))


@query("D24", sql="SELECT c_nationkey, arg_min(c_custkey, c_acctbal * 1000000 + c_custkey / 100000.0) AS winner FROM customer GROUP BY c_nationkey")
def roll_call(spark, sf_dir):
    """The lowest (timestamp, worker) of each round."""
    df = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").alias("at"), F.col("c_custkey").alias("worker"))
    return rec.roll_call(df, ["c_nationkey"]).select("c_nationkey", "winner")


@query("A24", sql=with_tables("reported", f"SELECT record_key, CASE WHEN count(DISTINCT holder) >= 7 THEN 2 ELSE 1 END AS level, {NOW_MS} AS asked_ms FROM reported GROUP BY record_key"))
def durability_level(spark, sf_dir):
    """How durably each record is kept: in memory (1), or stored by a quorum (2)."""
    held = reported(spark, sf_dir).groupBy("record_key").agg(F.count_distinct("holder").alias("n"))
    return held.select("record_key", F.when(F.col("n") >= 7, 2).otherwise(1).alias("level"), F.lit(NOW_MS).alias("asked_ms"))
