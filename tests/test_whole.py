"""Queries over whole inputs, against brute force over the same tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.operators import composites, payload, reduce
from weftline.registry import QUERIES
from weftline.sources import fixtures


@pytest.fixture
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()}


def test_map_keeps_every_item(spark, sf, texts):
    got = {r["doc_id"]: r["result"] for r in QUERIES["map_ordered"].build(spark, sf).collect()}
    assert max(t.count(" ") for t in texts.values()) > 8
    assert got == {d: " ".join(w[::-1] + str(len(w)) for w in t.split(" ")) for d, t in texts.items()}


def test_tree_keeps_every_line_and_word(spark, sf, texts):
    rows = QUERIES["tree_flatten"].build(spark, sf).where("depth = 2").collect()
    leaves: dict = {}
    for r in sorted(rows, key=lambda r: r["path"]):
        leaves.setdefault(r["doc_id"], []).append(r["value"])
    assert leaves == {d: [w for line in t.split("\n") for w in line.split(" ")] for d, t in texts.items()}
    got = {r["doc_id"]: r["nested"] for r in QUERIES["tree_resolve"].build(spark, sf).collect()}
    assert got == {d: t.replace("\n", "|").replace(" ", "+") for d, t in texts.items()}


def test_paths_of_a_million_items_stay_apart_and_in_order(spark):
    n = 1_000_003
    df = spark.range(1).select(F.col("id").alias("k"), F.array(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"))
    leaves = composites.flatten_tree(df, "t", "k").where("depth = 2")
    assert leaves.select("path").distinct().count() == n
    last = leaves.orderBy(F.desc("path")).select("value").limit(5).collect()
    assert [r["value"] for r in last] == [str(n - 1 - k) for k in range(5)]


def test_no_event_is_left_out_of_blobs_results_and_records(spark, sf):
    tasks = {r["task_id"]: r for r in fixtures.tasks(spark, sf).select("task_id", "queue", "ticket", "amount", "bytes", "submitted_ms", "payload").collect()}
    known, used, own, want = set(), {}, {}, {}
    for t in sorted(tasks.values(), key=lambda t: t["ticket"]):
        at, size, result = t["queue"], t["bytes"] * 300, t["task_id"] % 3 == 0
        old = (at, t["amount"] % 500) in known
        full = used.get(at, 0) + size > 9_000_000 or not result and own.get(at, 0) + size > 4_500_000
        want[t["task_id"]] = "too_large" if size > 262144 else "wrong_key" if t["task_id"] % 41 == 0 else "store_full" if full and not old else "stored"
        if want[t["task_id"]] == "stored" and not old:
            known.add((at, t["amount"] % 500))
            used[at] = used.get(at, 0) + size
            own[at] = own.get(at, 0) + (0 if result else size)
    assert {r["task_id"]: r["answer"] for r in QUERIES["blob_admission"].build(spark, sf).collect()} == want

    live = {k: hashlib.sha256(t["payload"].encode()).hexdigest() for k, t in tasks.items() if k % 97 != 8 and (k % 5 == 0 or t["submitted_ms"] + 864_000_000 > fixtures.NOW_MS)}
    assert {r["task_id"]: r["digest"] for r in QUERIES["resume_results"].build(spark, sf).collect()} == live

    newest: dict = {}
    for r in fixtures.reported(spark, sf).select("record_key", "report_id", "epoch", "revision", "holder").collect():
        v, reach = (r["epoch"], r["revision"]), r["holder"] % 4 == 0 and r["report_id"] % 9 == 0
        best = newest.get(r["record_key"], (False, (-1, -1)))
        newest[r["record_key"]] = max(best, (reach, v))
    got = {r["record_key"]: (r["reachable"], (r["epoch"], r["revision"])) for r in QUERIES["newest_reachable"].build(spark, sf).collect()}
    assert got == newest


def test_refused_blobs_take_no_room(spark):
    rows = [(k, d, n, True, True) for k, (d, n) in enumerate([("a", 100), ("b", 100), ("b", 100), ("c", 40), ("a", 100)])]
    df = spark.createDataFrame([("s", *r) for r in rows], "shard string, k int, digest string, size bigint, result boolean, right_key boolean")
    got = [r["answer"] for r in payload.blob_admission(df, "k", 150).orderBy("k").collect()]
    assert got == ["stored", "store_full", "store_full", "stored", "stored"]


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "parent bigint, child bigint")
    found = composites.closure(edges, spark.createDataFrame([(0,)], "id bigint"))
    assert sorted(r["id"] for r in found.collect()) == list(range(61))


def test_reduce_of_texts_and_of_nothing(spark):
    df = spark.createDataFrame([(["ab", "c"],)], "t array<string>")
    assert df.select(reduce.guarded(F.col("t"), lambda a, x: F.concat(a, x), None)).first()[0] == "abc"
    with pytest.raises(Exception, match="ReduceEmptyError"):
        df.select(reduce.guarded(F.array().cast("array<string>"), lambda a, x: F.concat(a, x), None)).collect()
