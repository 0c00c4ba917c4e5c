"""Bookkeeping of composites: batches, pages, counts, completion, nested results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.scan import ordered_scan
from weftline.sources import scratch

PAGE, BATCH_ITEMS, BATCH_BYTES = 1024, 1024, 512 << 10
SETTLED = ("succeeded", "failed", "cancelled")


def greedy_batches(df: DataFrame, keys: list[str], index: str, size: str, items: int = BATCH_ITEMS, bytes_: int = BATCH_BYTES) -> DataFrame:
    """The batch of each item: a batch closes before the item that would break either bound; an oversized item is alone."""

    def step(state: tuple[int, int, int], own: int) -> tuple[tuple[int, int, int], int]:
        n, used, batch = state
        if n >= items or n and used + own > bytes_:
            n, used, batch = 0, 0, batch + 1
        return (n + 1, used + own, batch), batch

    rows = df.select(*keys, F.col(index).alias("_i"), F.col(size).cast("bigint").alias("_s"))
    return ordered_scan(rows, keys, ["_i", "_s"], lambda: (0, 0, 0), step, ["_s"], "batch", T.LongType()).select(*keys, F.col("_i").alias(index), "batch")


def pages(df: DataFrame, keys: list[str], index: str, page: int = PAGE) -> DataFrame:
    """Items of each page and whether it is due: every index that it covers is settled."""
    total = df.groupBy(*keys).agg(F.max(index).alias("_last"))
    paged = df.withColumn("page", F.floor(F.col(index) / page).cast("bigint")).groupBy(*keys, "page").agg(F.count("*").alias("items"), F.count_if(F.col("state").isin(*SETTLED)).alias("settled"))
    due = F.col("settled") >= F.least((F.col("page") + 1) * page, F.col("_last") + 1) - F.col("page") * page
    return paged.join(total, keys).select(*keys, "page", "items", "settled", due.alias("due"))


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Members of each composite by how they stand; pending is what is neither settled nor running."""
    n = lambda s: F.count_if(F.col("state") == s)
    out = df.groupBy(*keys).agg(F.count("*").alias("members"), n("succeeded").alias("succeeded"), n("failed").alias("failed"), n("cancelled").alias("cancelled"), n("running").alias("running"))
    return out.withColumn("pending", F.greatest(F.lit(0), F.col("members") - F.col("succeeded") - F.col("failed") - F.col("cancelled") - F.col("running")))


def complete(counted: DataFrame, sealed: Column) -> DataFrame:
    """Composites that are sealed with every member settled."""
    return counted.where(sealed & (F.col("succeeded") + F.col("failed") + F.col("cancelled") == F.col("members")))


def member_outcomes(members: DataFrame, children: DataFrame) -> DataFrame:
    """What each member's end says: a value, a child composite's end, a failure; null while its child still runs."""
    joined = members.join(children.select(F.col("composite_id").alias("child_id"), F.col("state").alias("child_state"), F.col("failure_kind").alias("child_failure")), "child_id", "left")
    outcome = (
        F.when((F.col("state") == "succeeded") & F.col("child_id").isNull(), "value")
        .when((F.col("state") == "succeeded") & (F.col("child_state") == "running"), F.lit(None).cast("string"))
        .when((F.col("state") == "succeeded") & (F.col("child_state") == "succeeded"), "child")
        .when((F.col("state") == "succeeded") & F.col("child_state").isNotNull(), F.concat(F.lit("failed:"), F.coalesce("child_failure", F.lit("cancelled"))))
        .when(F.col("state") == "succeeded", "failed:lost")
        .when(F.col("state").isin(*SETTLED), F.concat(F.lit("failed:"), F.col("state")))
    )
    return joined.withColumn("outcome", outcome)


def append_batches(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Batches (start, items) as they arrive in seq: appended, a resend that changes nothing, or a gap that is refused."""

    def step(held: int, start: int, items: int) -> tuple[int, str]:
        if start > held:
            return held, "gap"
        return max(held, start + items), "resent" if start + items <= held else "appended"

    rows = batches.select(*keys, "seq", "start", "items")
    return ordered_scan(rows, keys, ["seq", "start", "items"], lambda: 0, step, ["start", "items"], "answer", T.StringType()).select(*keys, "seq", "answer")


def lost_items(stored: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Composites of which fewer items are stored than were recorded."""
    n = stored.groupBy(*keys).agg(F.count("*").alias("stored"))
    return recorded.join(n, keys, "left").withColumn("stored", F.coalesce("stored", F.lit(0))).where(F.col("stored") < F.col("recorded"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All composites below the roots (id) and these; edges: parent, child. Level after level to the last, each a table."""
    spark = edges.sparkSession
    edges = scratch.written(edges.select("parent", "child"), "edges")
    found = scratch.path(spark, "closure")
    level, depth = scratch.written(roots.select("id").distinct(), "closure", f"{found}/level=0"), 0
    while not level.isEmpty():
        seen = spark.read.schema(level.schema).parquet(*(f"{found}/level={k}" for k in range(depth + 1)))
        depth += 1
        below = level.join(edges, level["id"] == edges["parent"]).select(F.col("child").alias("id")).distinct()
        level = scratch.written(below.join(seen, "id", "left_anti"), "closure", f"{found}/level={depth}")
    return spark.read.schema(level.schema).parquet(*(f"{found}/level={k}" for k in range(depth + 1)))


def cancel(tasks: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Answers to cancelling the roots: for every task of their closure, and unknown for a root that no task belongs to and nothing is below."""
    held = closure(edges, roots).select(F.col("id").alias("composite_id"))
    live = tasks.join(held, "composite_id", "left_semi")
    answer = F.when(F.col("state").isin("scheduled", "queued", "claimed", "running", "pending"), "cancelled").otherwise("already_finished")
    live = live.withColumns({"answer": answer, "was_running": F.col("state").isin("claimed", "running")})
    missing = roots.select(F.col("id").alias("composite_id")).distinct().join(tasks, "composite_id", "left_anti").join(edges, F.col("composite_id") == edges["parent"], "left_anti")
    return live.unionByName(missing.withColumns({"answer": F.lit("unknown"), "was_running": F.lit(False)}), allowMissingColumns=True)


def _step(i: str) -> Column:
    """An index as a part of a path: six digits, from a million on ~ and ten, which sorts after them."""
    return F.when(F.col(i) < 1_000_000, F.lpad(F.col(i).cast("string"), 6, "0")).otherwise(F.concat(F.lit("~"), F.lpad(F.col(i).cast("string"), 10, "0")))


def flatten_tree(df: DataFrame, nested: str, key: str) -> DataFrame:
    """array<array<x>> in preorder: a row for each node with its path, depth and kind; paths sort in preorder."""
    head = df.select(key, F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit("list").alias("kind"), F.lit(None).cast("string").alias("value"))
    one = df.select(key, F.posexplode(nested).alias("i", "inner"))
    lists = one.select(key, _step("i").alias("path"), F.lit(1).alias("depth"), F.lit("list").alias("kind"), F.lit(None).cast("string").alias("value"))
    leaves = one.select(key, "i", F.posexplode("inner").alias("j", "v")).select(key, F.concat(_step("i"), F.lit("."), _step("j")).alias("path"), F.lit(2).alias("depth"), F.lit("value").alias("kind"), F.col("v").cast("string").alias("value"))
    return head.unionByName(lists).unionByName(leaves)


def unflatten_tree(nodes: DataFrame, key: str) -> DataFrame:
    """The reverse of flatten_tree()."""
    leaf = nodes.where("depth = 2").select(key, F.substring_index("path", ".", 1).alias("outer"), "path", "value")
    inner = leaf.groupBy(key, "outer").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: x["value"]).alias("values"))
    every = nodes.where("depth = 1").select(key, F.col("path").alias("outer")).join(inner, [key, "outer"], "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))
    lists = every.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("outer", "values"))), lambda x: x["values"]).alias("nested"))
    return nodes.where("depth = 0").select(key).join(lists, key, "left").withColumn("nested", F.coalesce("nested", F.array().cast("array<array<string>>")))


