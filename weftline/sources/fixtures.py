"""Task-system tables derived from the star schema: as DataFrames, and as SQL for oracles.

Wall time is bigint milliseconds since 1970; NOW_MS is the one moment that queries ask at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW_MS = 1_706_659_200_000  # 2024-01-31 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPARK_MS = "(datediff(cast(ts as date), date'1970-01-01') * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + cast(floor(extract(second from ts) * 1000) as bigint))"

_TASKS = """
  event_id AS task_id, event_type AS definition, CAST(user_id AS {string}) AS coalescing_key, event_type AS queue, {ms} AS submitted_ms,
  CAST(CASE WHEN event_id % 5 = 0 THEN (event_id % 7) * 60000 END AS bigint) AS delay_ms,
  CAST(CASE WHEN event_id % 3 = 0 THEN (1 + event_id % 48) * 3600000 END AS bigint) AS expiry_ms,
  event_id % 4 AS max_retries, event_id % 11 = 0 AS ephemeral, event_id % 13 = 0 AS non_retriable,
  props AS payload, CAST(round(value * 100) AS bigint) AS amount, 200 + event_id % 900 AS bytes, event_id AS ticket
"""
_RUN_STATE = """
  CASE WHEN attempt < 1 + task_id % 3 THEN CASE WHEN (task_id + attempt) % 2 = 0 THEN 'failed' ELSE 'lost' END
       WHEN task_id % 9 = 0 THEN 'scheduled' WHEN task_id % 9 = 1 THEN 'queued' WHEN task_id % 9 = 2 THEN 'claimed' WHEN task_id % 9 = 3 THEN 'running'
       WHEN task_id % 9 = 4 THEN 'succeeded' WHEN task_id % 9 = 5 THEN 'failed' WHEN task_id % 9 = 6 THEN 'cancelled' WHEN task_id % 9 = 7 THEN 'expired'
       ELSE 'superseded' END
"""
_RUNS = f"""
  concat(CAST(task_id AS {{string}}), '-', CAST(attempt AS {{string}})) AS run_id, task_id, CAST(attempt AS bigint) AS attempt, {_RUN_STATE} AS state,
  concat('w', CAST((task_id + attempt) % 20 AS {{string}})) AS worker, submitted_ms + attempt * 60000 AS updated_ms,
  CASE WHEN task_id % 2 = 0 THEN 'ValueError' ELSE 'TimeoutError' END AS failure_kind, max_retries, ephemeral, non_retriable, definition, coalescing_key, queue
"""
_MEMBERS = """
  l_orderkey AS composite_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS bigint) AS idx,
  CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_quantity < 5 THEN 'pending' WHEN l_quantity < 10 THEN 'running' WHEN l_quantity > 48 THEN 'cancelled' ELSE 'succeeded' END AS state,
  l_partkey AS value, CAST(l_quantity AS bigint) AS size
"""
_POLICY = "('error', 10, 1, NULL, NULL), ('purchase', 5, 3, 120, NULL), ('signup', 5, 1, NULL, 864000000), ('view', 0, 2, 200, 1296000000), ('click', -5, 1, NULL, 1728000000)"
# A report of a record by a holder: its version is lexicographic in (epoch, revision).
_REPORTED = """
  user_id AS record_key, event_id AS report_id, CAST(event_id % 3 AS bigint) AS epoch, CAST(event_id % 97 AS bigint) AS revision, event_id % 12 AS holder,
  event_type AS content, event_id % 4 = 0 AS finished
"""


_VOTERS = "CAST(n_nationkey AS bigint) AS worker, n_nationkey % 5 <> 0 AS is_member, n_nationkey % 3 <> 0 AS answered, n_nationkey % 4 AS generation"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Immutable submissions, one for each event."""
    return table(spark, sf_dir, "events").selectExpr(*_columns(_TASKS.format(string="string", ms=_SPARK_MS)))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of tasks: one to three each."""
    attempts = tasks(spark, sf_dir).selectExpr("*", "explode(sequence(1L, 1 + task_id % 3)) AS attempt")
    return attempts.selectExpr(*_columns(_RUNS.format(string="string")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of composites: an order is a composite, its lines are members."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_columns(_MEMBERS))


def policy(spark: SparkSession) -> DataFrame:
    """Queue options, one row for each queue."""
    return spark.sql(f"SELECT queue, CAST(priority AS bigint) priority, CAST(weight AS bigint) weight, CAST(max_running AS bigint) max_running, CAST(age_ms AS bigint) age_ms FROM VALUES {_POLICY} AS t(queue, priority, weight, max_running, age_ms)")


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of records as holders report them."""
    return table(spark, sf_dir, "events").selectExpr(*_columns(_REPORTED))


def voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers that hold records: one for each nation."""
    return table(spark, sf_dir, "nation").selectExpr(*_columns(_VOTERS))


def _columns(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:k])
            at = k + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


_SQL = {
    "tasks": f"SELECT {_TASKS.format(string='varchar', ms='(epoch_us(ts) // 1000)')} FROM events",
    "runs": f"SELECT {_RUNS.format(string='varchar')} FROM (SELECT *, unnest(generate_series(1, 1 + task_id % 3)) AS attempt FROM tasks)",
    "members": f"SELECT {_MEMBERS} FROM lineitem",
    "policy": f"SELECT queue, priority::BIGINT AS priority, weight::BIGINT AS weight, max_running::BIGINT AS max_running, age_ms::BIGINT AS age_ms FROM (VALUES {_POLICY}) t(queue, priority, weight, max_running, age_ms)",
    "reported": f"SELECT {_REPORTED} FROM events",
    "voters": f"SELECT {_VOTERS} FROM nation",
}
_NEEDS = {"runs": ("tasks",)}


def with_tables(names: str, select: str) -> str:
    """select with the named derived tables before it."""
    order: list[str] = []
    for n in names.split():
        for x in (*_NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    return "WITH " + ", ".join(f"{n} AS ({_SQL[n]})" for n in order) + " " + select
