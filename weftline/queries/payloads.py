"""Queries of payloads, results and schemas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import schemas
from weftline.functions.outcomes import length_prefixed_hash
from weftline.operators import payload
from weftline.operators import scheduling as sched
from weftline.registry import query
from weftline.sources import scratch
from weftline.sources.fixtures import NOW_MS, runs, table, tasks, with_tables
from weftline.sources.results import ResultStore

_CHUNK = 1000
_CHUNKS = f"""
WITH d AS (SELECT doc_id, encode(text) AS p FROM documents), n AS (SELECT doc_id, p, unnest(generate_series(0, ceil(octet_length(p) / {_CHUNK}.0)::BIGINT - 1)) AS idx FROM d),
c AS (SELECT doc_id, idx, unhex(substring(hex(p), (idx * {2 * _CHUNK} + 1)::BIGINT, {2 * _CHUNK})) AS bytes FROM n)"""


def _text_chunks(spark, sf_dir):
    return payload.chunks(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _CHUNK)


@query("E1", sql=_CHUNKS + " SELECT doc_id, idx, octet_length(bytes) AS size, sha256(bytes) AS digest FROM c")
def payload_chunks(spark, sf_dir):
    """Texts cut to pieces of 1000 bytes."""
    return _text_chunks(spark, sf_dir).select("doc_id", "idx", F.octet_length("bytes").cast("bigint").alias("size"), "digest")


@query("E2", sql="""
SELECT page_id, n <= 131072 AS inline, n <= 65536 AS backend_inline, CASE WHEN n <= 131072 THEN 0 ELSE ceil(n / 262144.0) END::BIGINT AS blobs FROM (SELECT page_id, octet_length(encode(html)) * 40 AS n FROM pages WHERE html IS NOT NULL)""")  # fmt: skip
def payload_carried(spark, sf_dir):
    """How results of each size travel."""
    df = table(spark, sf_dir, "pages").where("html is not null").select("page_id", payload.carried(F.octet_length("html") * 40).alias("c"))
    return df.select("page_id", "c.*")


@query("E3", sql="""
SELECT doc_id, CASE WHEN doc_id % 10 = 1 AND octet_length(encode(text)) > 0 THEN 'missing' WHEN doc_id % 10 = 2 AND octet_length(encode(text)) > 0 THEN 'corrupt' WHEN doc_id % 10 = 3 THEN 'wrong_length' ELSE 'ok' END AS verdict,
  CASE WHEN doc_id % 10 NOT IN (1, 2, 3) THEN sha256(text) END AS payload FROM documents WHERE octet_length(encode(text)) > 0""")  # fmt: skip
def payload_verify(spark, sf_dir):
    """Payloads put together from their pieces and checked."""
    pieces = _text_chunks(spark, sf_dir).withColumn("digest", F.concat("digest", F.when(F.col("doc_id") % 10 == 1, "-").otherwise("")))
    total = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") + (F.col("doc_id") % 10 == 3).cast("int")).cast("bigint").alias("total"))
    # a corrupt piece of its own: named by one digest, holding other bytes
    spoiled = F.col("doc_id") % 10 == 2
    named = pieces.withColumn("digest", F.when(spoiled, F.concat("digest", F.col("doc_id").cast("string"))).otherwise(F.col("digest")))
    manifest = named.join(total, "doc_id").select("doc_id", "idx", "digest", "total")
    blobs = named.where("doc_id % 10 <> 1").select("digest", "bytes").dropDuplicates(["digest"])
    whole = payload.reassemble(manifest, blobs, "doc_id")
    return whole.select("doc_id", "verdict", F.sha2("payload", 256).alias("payload"))


@query("E4", sql="SELECT p_partkey, blobs, total, blobs = 0 OR total BETWEEN (blobs - 1) * 262144 + 1 AND blobs * 262144 AS sane FROM (SELECT p_partkey, p_size % 4 AS blobs, (p_partkey * 7919) % 1000000 AS total FROM part)")
def manifest_sane(spark, sf_dir):
    """Whether manifests' blobs can hold their totals."""
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("blobs"), (F.col("p_partkey") * 7919 % 1000000).alias("total"))
    return df.withColumn("sane", payload.manifest_sane(F.col("blobs"), F.col("total")))


@query("E5", sql=_CHUNKS + " SELECT sha256(bytes) AS digest, count(DISTINCT doc_id) AS owners, count(*) AS uses, max(octet_length(bytes)) AS size FROM c GROUP BY ALL")
def blob_dedup(spark, sf_dir):
    """Each distinct piece once, with its owners."""
    return payload.shared_blobs(_text_chunks(spark, sf_dir).withColumnRenamed("doc_id", "owner"))


@query("E5", sql=_CHUNKS + ", b AS (SELECT doc_id, sha256(bytes) AS digest FROM c) SELECT DISTINCT digest FROM b WHERE digest NOT IN (SELECT digest FROM b WHERE doc_id % 3 = 0)")
def blob_garbage(spark, sf_dir):
    """Pieces of which no owner is alive."""
    blobs = _text_chunks(spark, sf_dir).withColumnRenamed("doc_id", "owner")
    return payload.garbage(blobs, blobs.where("owner % 3 = 0").select("owner").distinct())


@query("E6", "E7", sql=_CHUNKS + """
SELECT doc_id AS key, idx AS part, 0 AS phase FROM c WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, NULL, 1 FROM documents WHERE doc_id % 4 <> 0""")  # fmt: skip
def store_entries(spark, sf_dir):
    """What is written for results not stored yet: parts first, heads last."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    parts = _text_chunks(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("idx").alias("part"))
    stored = docs.select("key", (F.col("key") % 4 == 0).alias("complete"))
    return payload.store_unless_complete(payload.store_entries(docs, parts), stored, "key")


@query("E8", "A25", "F10", sql=with_tables("tasks", f"SELECT task_id, sha256(payload) AS digest FROM tasks WHERE (task_id % 5 = 0 OR submitted_ms + 864000000 > {NOW_MS}) AND task_id % 97 <> 8"))
def resume_results(spark, sf_dir):
    """Results stored, some then damaged, and read again by id: what has expired is gone, and so is what no longer has its digest."""
    until = F.when(F.col("task_id") % 5 != 0, F.col("submitted_ms") + 864_000_000)
    whole, damaged = (ResultStore(spark, scratch.path(spark, f"results-{name}"), 1) for name in ("whole", "damaged"))
    whole.store(tasks(spark, sf_dir).select(F.col("task_id").alias("key"), "payload", until.alias("expires_ms")), None, NOW_MS)
    whole.heads().repartition("prefix").write.partitionBy("prefix").parquet(f"{damaged.path}/heads")
    parts = spark.read.schema("key string, payload binary, prefix string").parquet(f"{whole.path}/parts")
    broken = F.when(F.col("key").cast("bigint") % 97 == 8, F.concat("payload", F.lit("!").cast("binary"))).otherwise(F.col("payload"))
    parts.withColumn("payload", broken).repartition("prefix").write.partitionBy("prefix").parquet(f"{damaged.path}/parts")
    return damaged.load(None, NOW_MS).select(F.col("key").cast("bigint").alias("task_id"), F.sha2("payload", 256).alias("digest"))


@query("E9", sql=with_tables("runs", """
, n AS (SELECT task_id, arg_max(state, attempt) AS state FROM runs WHERE task_id % 13 <> 0 GROUP BY task_id)
SELECT task_id, CASE WHEN state IS NULL THEN 'unknown' WHEN state IN ('scheduled', 'queued', 'claimed', 'running') THEN 'unfinished' WHEN state = 'succeeded' AND task_id % 4 = 0 THEN 'continued'
  WHEN state = 'succeeded' AND task_id % 10 <> 3 THEN 'succeeded' WHEN state = 'succeeded' THEN 'unknown' ELSE 'ended:' || state END AS standing FROM tasks LEFT JOIN n USING (task_id)""").replace(") \n, n AS", "), n AS"))  # fmt: skip
def task_standing(spark, sf_dir):
    """How tasks stand for a backend."""
    newest = sched.newest_run(runs(spark, sf_dir).where("task_id % 13 <> 0")).select("task_id", "state")
    joined = tasks(spark, sf_dir).join(newest, "task_id", "left")
    digest = F.when(F.col("task_id") % 10 != 3, F.sha2("payload", 256))
    return joined.select("task_id", payload.standing(F.col("state"), F.col("task_id") % 4 == 0, digest).alias("standing"))


@query("E11", sql="""SELECT event_id, '{"kind":"' || event_type || '","note":' || CASE WHEN user_id % 2 = 0 THEN 'null' ELSE '"n' || user_id || '"' END || ',"user":' || user_id || '}' AS canonical FROM events""")
def canonical_json(spark, sf_dir):
    """JSON with sorted keys, no white space and nulls kept."""
    note = F.when(F.col("user_id") % 2 == 1, F.concat(F.lit("n"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", schemas.canonical_json(user=F.col("user_id"), kind=F.col("event_type"), note=note).alias("canonical"))


_VERSIONED = """CASE event_id % 6 WHEN 0 THEN '{"version":1,"quantity":' || user_id || ',"junk":true}' WHEN 1 THEN '{"version":2,"quantity":' || user_id || ',"note":"x"}' WHEN 2 THEN '{"version":3,"quantity":' || user_id || ',"rush":true}'
  WHEN 3 THEN '{"version":true,"quantity":1}' WHEN 4 THEN '{"version":9,"quantity":1}' ELSE '{"quantity":1}' END"""


def _orders_family() -> schemas.Family:
    """Quantity doubles from version 1 to 2; version 3 drops note and adds rush."""
    number, text = T.LongType(), T.StringType()
    v1 = T.StructType([T.StructField("version", number), T.StructField("quantity", number)])
    v2 = T.StructType([*v1.fields, T.StructField("note", text)])
    v3 = T.StructType([*v1.fields, T.StructField("rush", T.BooleanType())])
    double = lambda c: F.struct(F.lit(2).cast("bigint").alias("version"), (c["quantity"] * 2).alias("quantity"), F.lit("").alias("note"))
    return schemas.Family("order", {1: v1, 2: v2, 3: v3}, {1: double, 2: None}, {"rush": False})


def _versioned(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", f"{_VERSIONED.replace('|| user_id ||', '|| CAST(user_id AS string) ||')} AS payload")


_TYPED = """CASE event_id % 7 WHEN 0 THEN '{"version":"3","quantity":1}' WHEN 1 THEN '{"version":3.0,"quantity":1}' WHEN 2 THEN '{"version":null}' ELSE payload END"""


@query("E12", sql=f"""
SELECT event_id, CASE WHEN event_id % 7 < 3 THEN NULL ELSE CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 9 END END::BIGINT AS version, {_TYPED} AS payload
FROM (SELECT event_id, {_VERSIONED} AS payload FROM events)""")
def version_path(spark, sf_dir):
    """Integer versions in payloads; booleans, texts and fractions are none."""
    return _versioned(spark, sf_dir).selectExpr("event_id", f"{_TYPED} AS payload").select("event_id", schemas.version_of(F.col("payload")).alias("version"), "payload")


@query("E13", sql="SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'runnable:2' WHEN 1 THEN 'runnable:1' WHEN 2 THEN 'runnable:0' WHEN 4 THEN 'newer' ELSE 'unknown' END AS plan FROM events")
def migration_plan(spark, sf_dir):
    """How many steps each payload needs, or why it can't run."""
    return _versioned(spark, sf_dir).select("event_id", schemas.plan(_orders_family(), schemas.version_of(F.col("payload"))).alias("plan"))


@query("E14", "E15", sql="SELECT event_id, user_id * CASE WHEN event_id % 6 = 0 THEN 2 ELSE 1 END AS quantity, event_id % 6 = 2 AS rush FROM events WHERE event_id % 6 < 3")
def migrate_payload(spark, sf_dir):
    """Payloads brought to the current version, one step at a time."""
    df = _versioned(spark, sf_dir)
    out = df.withColumn("m", schemas.migrate(_orders_family(), F.col("payload"), schemas.version_of(F.col("payload")))).where("m is not null")
    return out.select("event_id", "m.quantity", "m.rush")


@query("E16", sql="""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'unknown:1,missing:rush' WHEN 1 THEN 'unknown:1,missing:rush' WHEN 2 THEN '' WHEN 3 THEN 'type:version,missing:rush' WHEN 4 THEN 'missing:rush' ELSE 'missing:version,missing:rush' END AS problems FROM events""".replace("'type:version,missing:rush'", "'type:version,missing:rush'"))  # fmt: skip
def validate_payload(spark, sf_dir):
    """What is wrong with each payload for the current version."""
    want = _orders_family().versions[3]
    return _versioned(spark, sf_dir).select("event_id", F.array_join(schemas.problems(F.col("payload"), want), ",").alias("problems"))


_NESTED = """CASE event_id % 4 WHEN 0 THEN '{"order":{"quantity":5,"note":null},"tags":[]}' WHEN 1 THEN '{"order":{"quantity":"5","note":"a"},"tags":[]}'
  WHEN 2 THEN '{"order":{"note":"a","junk":1},"tags":{}}' ELSE '{"order":7,"tags":[],"x":1}' END"""


@query("E16", sql="SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'type:order.quantity' WHEN 2 THEN 'unknown:order:1,missing:order.quantity,type:tags' ELSE 'unknown:1,type:order' END AS problems FROM events")
def validate_nested(spark, sf_dir):
    """What is wrong with payloads whose structs hold structs."""
    order = T.StructType([T.StructField("quantity", T.LongType()), T.StructField("note", T.StringType())])
    want = T.StructType([T.StructField("order", order), T.StructField("tags", T.ArrayType(T.StringType()))])
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_NESTED} AS payload")
    return rows.select("event_id", F.array_join(schemas.problems(F.col("payload"), want), ",").alias("problems"))


@query("E11", sql="""
SELECT event_id, '{"list":[{"a":' || user_id || ',"b":null},{"a":1,"b":"x"}],"map":{"k":2,"z":' || user_id || '},"user":' || CASE WHEN user_id % 2 = 0 THEN 'null' ELSE '{"a":"' || event_type || '","z":' || user_id || '}' END || '}' AS canonical FROM events""")  # fmt: skip
def canonical_nested(spark, sf_dir):
    """Sorted keys in structs, lists and maps at every depth."""
    one = lambda b, a: F.struct(F.lit(b).cast("string").alias("b"), a.cast("bigint").alias("a"))
    user = F.when(F.col("user_id") % 2 == 1, F.struct(F.col("user_id").alias("z"), F.col("event_type").alias("a")))
    maps = F.create_map(F.lit("z"), F.col("user_id"), F.lit("k"), F.lit(2).cast("bigint"))
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(user.alias("user"), maps.alias("map"), F.array(one(None, F.col("user_id")), one("x", F.lit(1))).alias("list")).alias("v"))
    return rows.select("event_id", schemas.canonical_text(F.col("v"), rows.schema["v"].dataType).alias("canonical"))


@query("E15", sql="""
SELECT event_id, '{"by":{"k":{"amount":' || user_id || ',"rush":false}},"lines":[{"amount":' || user_id || ',"rush":false},{"amount":2,"rush":false}],"rush":false}' AS now FROM events""")  # fmt: skip
def conform_nested(spark, sf_dir):
    """A default step through lists and maps: fields that are gone are dropped, new ones defaulted."""
    old = T.StructType([T.StructField("amount", T.IntegerType()), T.StructField("junk", T.StringType())])
    new = T.StructType([T.StructField("amount", T.LongType()), T.StructField("rush", T.BooleanType())])
    shape = lambda t, *more: T.StructType([T.StructField("by", T.MapType(T.StringType(), t)), T.StructField("lines", T.ArrayType(t)), *more])
    one = lambda n: F.struct(n.cast("int").alias("amount"), F.lit("x").alias("junk"))
    value = F.struct(F.create_map(F.lit("k"), one(F.col("user_id"))).alias("by"), F.array(one(F.col("user_id")), one(F.lit(2))).alias("lines"))
    now = schemas.conform(value, shape(old), shape(new, T.StructField("rush", T.BooleanType())), {"rush": False})
    return table(spark, sf_dir, "events").select("event_id", F.to_json(now).alias("now"))


@query("E19", sql="SELECT event_id, CAST('0x' || left(sha256(length(event_type) || ':' || event_type || length(user_id::VARCHAR) || ':' || user_id), 15) AS BIGINT) AS hash FROM events")
def field_hash(spark, sf_dir):
    """Hashes of length-prefixed fields."""
    return table(spark, sf_dir, "events").select("event_id", length_prefixed_hash(F.col("event_type"), F.col("user_id")).alias("hash"))


@query("E20", sql=with_tables("tasks", """
, b AS (SELECT queue AS shard, task_id, amount % 500 AS digest, bytes * 300 AS size, task_id % 3 = 0 AS result, task_id % 41 <> 0 AS right_key, row_number() OVER (PARTITION BY queue ORDER BY ticket) AS n FROM tasks),
f AS (SELECT DISTINCT shard, 0::BIGINT AS n, NULL::BIGINT AS task_id, ''::VARCHAR AS answer, []::BIGINT[] AS held, 0::BIGINT AS used, 0::BIGINT AS inputs FROM b
  UNION ALL SELECT shard, n, task_id, answer, CASE WHEN answer = 'stored' AND NOT known THEN list_append(held, digest) ELSE held END,
    used + CASE WHEN answer = 'stored' AND NOT known THEN size ELSE 0 END, inputs + CASE WHEN answer = 'stored' AND NOT known AND NOT result THEN size ELSE 0 END
  FROM (SELECT b.shard, b.n, b.task_id, b.digest, b.size, b.result, f.held, f.used, f.inputs, list_contains(f.held, b.digest) AS known,
    CASE WHEN b.size > 262144 THEN 'too_large' WHEN NOT b.right_key THEN 'wrong_key' WHEN list_contains(f.held, b.digest) THEN 'stored'
      WHEN f.used + b.size > 9000000 OR (NOT b.result AND f.inputs + b.size > 4500000) THEN 'store_full' ELSE 'stored' END AS answer
    FROM f JOIN b ON b.shard = f.shard AND b.n = f.n + 1))
SELECT task_id, answer FROM f WHERE n > 0""").replace(") \n, b AS", "), b AS").replace("WITH tasks", "WITH RECURSIVE tasks"))  # fmt: skip
def blob_admission(spark, sf_dir):
    """Which blobs a store with a share limit admits."""
    df = tasks(spark, sf_dir).select(F.col("queue").alias("shard"), "ticket", "task_id", (F.col("amount") % 500).alias("digest"), (F.col("bytes") * 300).alias("size"), (F.col("task_id") % 3 == 0).alias("result"), (F.col("task_id") % 41 != 0).alias("right_key"))
    return payload.blob_admission(df, "ticket", 9_000_000).select("task_id", "answer")
