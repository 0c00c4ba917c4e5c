"""Queries of composite bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.outcomes import child_id
from weftline.operators import composites as comp
from weftline.registry import query
from weftline.sources.fixtures import members, table, with_tables


@query("C1", sql=with_tables("members", """
, l AS (SELECT composite_id, list(size ORDER BY idx) AS s FROM members GROUP BY composite_id),
r AS (SELECT composite_id, s, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS batch FROM l UNION ALL
  SELECT composite_id, s, i + 1, CASE WHEN n >= 3 OR (n > 0 AND used + s[i + 1] > 60) THEN 1 ELSE n + 1 END, CASE WHEN n >= 3 OR (n > 0 AND used + s[i + 1] > 60) THEN s[i + 1] ELSE used + s[i + 1] END,
    batch + (n >= 3 OR (n > 0 AND used + s[i + 1] > 60))::BIGINT FROM r WHERE i < len(s))
SELECT composite_id, i - 1 AS idx, batch FROM r WHERE i > 0""").replace(") \n, l AS", "), l AS").replace("WITH members", "WITH RECURSIVE members"))  # fmt: skip
def greedy_batches(spark, sf_dir):
    """Members in batches of at most 3 items and 60 bytes."""
    return comp.greedy_batches(members(spark, sf_dir), ["composite_id"], "idx", "size", items=3, bytes_=60)


@query("C2", "C3", sql=with_tables("members", """
SELECT composite_id, page, items, settled, settled >= least((page + 1) * 2, last + 1) - page * 2 AS due FROM (
  SELECT composite_id, idx // 2 AS page, count(*) AS items, count(*) FILTER (state IN ('succeeded', 'failed', 'cancelled')) AS settled FROM members GROUP BY ALL)
JOIN (SELECT composite_id, max(idx) AS last FROM members GROUP BY ALL) USING (composite_id)"""))  # fmt: skip
def page_due(spark, sf_dir):
    """Pages of two members, and whether each is due."""
    return comp.pages(members(spark, sf_dir), ["composite_id"], "idx", page=2)


_COUNTS = """SELECT composite_id, count(*) AS members, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled,
  count(*) FILTER (state = 'running') AS running, count(*) FILTER (state NOT IN ('succeeded', 'failed', 'cancelled', 'running')) AS pending FROM members GROUP BY composite_id"""


@query("C4", sql=with_tables("members", _COUNTS))
def member_counts(spark, sf_dir):
    """Members of each composite by how they stand."""
    return comp.counts(members(spark, sf_dir), ["composite_id"])


@query("C5", sql=with_tables("members", f"SELECT composite_id, members FROM ({_COUNTS}) WHERE composite_id % 7 <> 0 AND succeeded + failed + cancelled = members"))
def composite_complete(spark, sf_dir):
    """Sealed composites with every member settled."""
    return comp.complete(comp.counts(members(spark, sf_dir), ["composite_id"]), F.col("composite_id") % 7 != 0).select("composite_id", "members")


@query("C6", sql=with_tables("members", """
, m AS (SELECT *, CASE WHEN value % 5 = 0 THEN value % 60 END AS child_id FROM members),
c AS (SELECT i AS child_id, CASE i % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'failed' ELSE 'cancelled' END AS child_state, CASE WHEN i % 4 = 2 THEN 'ValueError' END AS child_failure FROM range(0, 50) t(i))
SELECT composite_id, idx, CASE WHEN state = 'succeeded' AND m.child_id IS NULL THEN 'value' WHEN state = 'succeeded' AND child_state = 'running' THEN NULL WHEN state = 'succeeded' AND child_state = 'succeeded' THEN 'child'
  WHEN state = 'succeeded' AND child_state IS NOT NULL THEN 'failed:' || coalesce(child_failure, 'cancelled') WHEN state = 'succeeded' THEN 'failed:lost' WHEN state IN ('failed', 'cancelled') THEN 'failed:' || state END AS outcome
FROM m LEFT JOIN c ON m.child_id = c.child_id""").replace(") \n, m AS", "), m AS"))  # fmt: skip
def member_outcomes(spark, sf_dir):
    """What each member's end says, through child composites."""
    m = members(spark, sf_dir).withColumn("child_id", F.when(F.col("value") % 5 == 0, F.col("value") % 60))
    state = F.element_at(F.array(*map(F.lit, ("running", "succeeded", "failed", "cancelled"))), (F.col("id") % 4 + 1).cast("int"))
    children = spark.range(50).select(F.col("id").alias("composite_id"), state.alias("state"), F.when(F.col("id") % 4 == 2, F.lit("ValueError")).alias("failure_kind"))
    return comp.member_outcomes(m, children).select("composite_id", "idx", "outcome")


@query("C7", sql=with_tables("members", """
, b AS (SELECT composite_id, idx AS seq, greatest(0, idx * 2 - (value % 3))::BIGINT AS start, 2::BIGINT AS items FROM members),
l AS (SELECT composite_id, list({'seq': seq, 'start': start, 'items': items} ORDER BY seq) AS s FROM b GROUP BY composite_id),
r AS (SELECT composite_id, s, 0::BIGINT AS i, 0::BIGINT AS held, ''::VARCHAR AS answer FROM l UNION ALL
  SELECT composite_id, s, i + 1, CASE WHEN s[i + 1].start > held THEN held ELSE greatest(held, s[i + 1].start + s[i + 1].items) END,
    CASE WHEN s[i + 1].start > held THEN 'gap' WHEN s[i + 1].start + s[i + 1].items <= held THEN 'resent' ELSE 'appended' END FROM r WHERE i < len(s))
SELECT composite_id, s[i].seq AS seq, answer FROM r WHERE i > 0""").replace(") \n, b AS", "), b AS").replace("WITH members", "WITH RECURSIVE members"))  # fmt: skip
def batch_append(spark, sf_dir):
    """Batches are appended without gaps; resends change nothing."""
    b = members(spark, sf_dir).select("composite_id", F.col("idx").alias("seq"), F.greatest(F.lit(0), F.col("idx") * 2 - F.col("value") % 3).cast("bigint").alias("start"), F.lit(2).cast("bigint").alias("items"))
    return comp.append_batches(b, ["composite_id"])


@query("C8", sql=with_tables("members", """
, s AS (SELECT composite_id, count(*) AS stored FROM members WHERE value % 9 <> 0 GROUP BY ALL), n AS (SELECT composite_id, count(*) AS recorded FROM members GROUP BY ALL)
SELECT composite_id, recorded, coalesce(stored, 0) AS stored FROM n LEFT JOIN s USING (composite_id) WHERE coalesce(stored, 0) < recorded""").replace(") \n, s AS", "), s AS"))  # fmt: skip
def items_lost(spark, sf_dir):
    """Reduces of which stored items are fewer than recorded."""
    m = members(spark, sf_dir)
    return comp.lost_items(m.where("value % 9 <> 0"), m.groupBy("composite_id").agg(F.count("*").alias("recorded")), ["composite_id"])


def _sql_step(i: str) -> str:
    return f"CASE WHEN {i} < 1000000 THEN lpad(({i})::VARCHAR, 6, '0') ELSE '~' || lpad(({i})::VARCHAR, 10, '0') END"


@query("C10", "E10", sql=f"""
WITH n AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')) AS t FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM n),
v AS (SELECT doc_id, i, unnest(t[i]) AS value, unnest(generate_series(1, len(t[i]))) AS j FROM o)
SELECT doc_id, '' AS path, 0 AS depth, 'list' AS kind, NULL::VARCHAR AS value FROM n
UNION ALL SELECT doc_id, {_sql_step("i - 1")}, 1, 'list', NULL FROM o
UNION ALL SELECT doc_id, ({_sql_step("i - 1")}) || '.' || ({_sql_step("j - 1")}), 2, 'value', value FROM v""")  # fmt: skip
def tree_flatten(spark, sf_dir):
    """Nested results as preorder rows: every line and word of a text."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.split(x, " "))
    return comp.flatten_tree(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", lines.alias("t")), "t", "doc_id")


@query("C10", "E10", sql="""
SELECT doc_id, array_to_string(list_transform(list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')), lambda x: array_to_string(x, '+')), '|') AS nested FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def tree_resolve(spark, sf_dir):
    """Preorder rows put back into nested lists."""
    nested = comp.unflatten_tree(tree_flatten(spark, sf_dir), "doc_id")
    return nested.select("doc_id", F.array_join(F.transform("nested", lambda x: F.array_join(x, "+")), "|").alias("nested"))


@query("C11", sql="""
SELECT composite_id, idx, sha256('6:member' || length(composite_id::VARCHAR) || ':' || composite_id || length(idx::VARCHAR) || ':' || idx) AS child FROM (
  SELECT o_custkey AS composite_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders)""")  # fmt: skip
def child_ids(spark, sf_dir):
    """Ids of members, the same however often they are made."""
    from pyspark.sql import Window as W

    idx = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("bigint")
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("composite_id"), idx.alias("idx"))
    return df.withColumn("child", child_id("member", F.col("composite_id"), F.col("idx")))


@query("A21", sql=with_tables("members", """
, e AS (SELECT DISTINCT composite_id // 4 AS parent, composite_id AS child FROM members WHERE composite_id > 0),
c AS (SELECT DISTINCT composite_id AS id FROM members WHERE composite_id % 97 = 5 UNION SELECT e.child FROM c JOIN e ON c.id = e.parent)
SELECT composite_id, idx, CASE WHEN state IN ('pending', 'running') THEN 'cancelled' ELSE 'already_finished' END AS answer, state = 'running' AS was_running FROM members WHERE composite_id IN (SELECT id FROM c)
UNION ALL SELECT -1, NULL, 'unknown', false""").replace(") \n, e AS", "), e AS").replace("WITH members", "WITH RECURSIVE members"))  # fmt: skip
def cancel_cascade(spark, sf_dir):
    """Cancelling composites reaches the members of all composites below."""
    m = members(spark, sf_dir)
    edges = m.where("composite_id > 0").selectExpr("composite_id div 4 AS parent", "composite_id AS child").distinct()
    roots = m.where("composite_id % 97 = 5").select(F.col("composite_id").alias("id")).distinct().unionByName(spark.range(-1, 0))
    return comp.cancel(m, edges, roots).select("composite_id", "idx", "answer", "was_running")
