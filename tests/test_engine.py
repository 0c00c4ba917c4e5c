"""What SQL can't hold the operators against."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import bodies, outcomes, schemas
from weftline.operators import reduce, scheduling
from weftline.plans import tree
from weftline.sources.results import ResultStore, deliver

add = lambda a, x: a + x


def test_truncate_bytes_keeps_whole_characters(spark):
    texts = ["", "a" * 10, "é" * 10, "漢" * 10, "😀" * 5, "aé漢😀" * 3, "x" * 7 + "😀", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in range(4, 14):
        got = [r[0] for r in df.select(outcomes.truncate_bytes(F.col("t"), limit)).collect()]
        assert got == [None if t is None else t.encode()[:limit].decode(errors="ignore") for t in texts]


def test_fair_claim_follows_turns(spark):
    """One claim over queues of weights 3 and 1 beside an urgent and a starving queue."""
    tickets = ["old"] + ["a"] * 6 + ["b"] * 6 + ["urgent"] * 2
    rows = [(k, q, 0 if q == "old" else 100_000, k) for k, q in enumerate(tickets)]
    df = spark.createDataFrame(rows, "task_id bigint, queue string, submitted_ms bigint, ticket bigint")
    policy = spark.createDataFrame([("urgent", 10, 1, None, None), ("a", 0, 3, None, None), ("b", 0, 1, None, None), ("old", -5, 1, None, 60_000)], "queue string, priority bigint, weight bigint, max_running bigint, age_ms bigint")
    busy = spark.createDataFrame([], "queue string, running bigint")
    got = [r["queue"] for r in scheduling.fair_claim(df, policy, busy, 100_000, 10).orderBy(F.desc("starving"), F.desc("tier"), "round", "ticket").collect()]
    assert got == ["old", "urgent", "urgent", "a", "a", "a", "b", "a", "a", "a"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 64])
def test_tree_equals_chain(spark, chunk):
    random.seed(chunk)
    rows = [(k, i, f"{k}.{i};") for k in range(5) for i in range(random.randrange(1, 20))]
    df = spark.createDataFrame(rows, "k bigint, i bigint, v string").repartition(3)
    join = lambda a, x: F.concat(a, x)
    chain = {r["k"]: r["result"] for r in reduce.chain(df, ["k"], ["i"], F.col("v"), join).collect()}
    found = reduce.tree(df, ["k"], "i", F.col("v"), join, chunk=chunk).collect()
    assert {r["k"]: r["result"] for r in found} == chain == {k: "".join(v for kk, _, v in rows if kk == k) for k in range(5)}
    assert all(r["steps"] == 2 * -(-r["items"] // chunk) - 1 for r in found)


def test_empty_reduce_without_seed_is_an_error(spark):
    df = spark.sql("SELECT cast(array() as array<bigint>) AS xs")
    assert df.select(reduce.guarded(F.col("xs"), add, F.lit(7).cast("bigint"))).first()[0] == 7
    with pytest.raises(Exception, match="ReduceEmptyError"):
        df.select(reduce.guarded(F.col("xs"), add, None)).collect()


def test_plans_are_checked_and_compiled(spark):
    number, text = T.LongType(), T.StringType()
    split = tree.Task(lambda c: F.split(c, ","), text, T.ArrayType(text))
    size = tree.Task(lambda c: F.length(c).cast("bigint"), text, number)
    total = tree.Reduce(add, seed=0, associative=True, tree=True, chunk=2, type=number)
    plan = tree.flow(split, size.map, total, size.bind("four"), tree.group(tree.Task(lambda c: c + 1, number), tree.Task(lambda c: c * 2, number)))
    assert tree.describe(plan) == "flow(task, map(task), reduce, bound, group(task, task))"
    df = spark.createDataFrame([("a,bb,ccc",), ("",)], "t string")
    got = [r[0] for r in df.select(plan.column(F.col("t"))).collect()]
    assert [(r["s1"], r["s2"], r["s3"], tuple(r["s4"])) for r in got] == [([1, 2, 3], 6, 4, (5, 8)), ([0], 0, 4, (5, 8))]
    for bad in (lambda: tree.flow(total), lambda: tree.flow(split, total), lambda: tree.Reduce(add, tree=True), lambda: tree.Reduce(lambda a: a), lambda: tree.Task(add), lambda: tree.flow(), lambda: tree.group()):
        with pytest.raises(tree.PlanError):
            bad()


def test_bodies_retry_and_report(spark):
    def flaky(x):
        if x < 0:
            raise ValueError("negative")
        return x * 2

    async def later(x):
        return x + 1

    df = spark.createDataFrame([(1,), (-1,)], "x bigint")
    got = {r["x"]: r["outcome"] for r in bodies.run(df, bodies.task("bigint", retries=2)(flaky), "x").collect()}
    assert got[1]["ok"] and got[1]["value"] == 2 and got[1]["attempts"] == 1
    assert not got[-1]["ok"] and got[-1]["failure_kind"] == "ValueError" and got[-1]["failure_message"] == "negative" and got[-1]["attempts"] == 3
    assert sorted(r["outcome"]["value"] for r in bodies.run(df, bodies.task("bigint", timeout_s=5.0)(later), "x").collect()) == [0, 2]
    assert bodies.task("bigint")(later).local(4) == 5
    with pytest.raises(Exception, match="pickle|local object"):
        bodies.task("bigint")(lambda x: x).local(lambda: 1)

    def slow(x):
        import time

        time.sleep(30 if x < 0 else 0)
        return x

    got = {r["x"]: r["outcome"] for r in bodies.run(df, bodies.task("bigint", timeout_s=0.5)(slow), "x").collect()}
    assert got[1]["ok"] and got[-1]["failure_kind"] == "TimeoutError"
    with pytest.raises(TypeError):
        bodies.task("bigint")(add)


def test_result_store_keeps_and_expires(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/results")
    store.store(spark.createDataFrame([("a", b"1"), ("b", b"2")], "key string, payload binary"), 1000, 0)
    store.store(spark.createDataFrame([("a", b"other"), ("c", b"3")], "key string, payload binary"), None, 0)
    load = lambda keys, now: {r["key"]: bytes(r["payload"]) for r in store.load(keys, now).collect()}
    assert load(None, 500) == {"a": b"1", "b": b"2", "c": b"3"}
    assert load(None, 5000) == {"c": b"3"}
    assert load(["b"], 500) == {"b": b"2"}
    seen, said = [], []

    def callback(row):
        seen.append(row["key"])
        raise RuntimeError("no")

    assert deliver(store.load(None, 500), callback, said.append) == 3 == len(seen) == len(said)


def test_not_a_number_is_refused(spark):
    assert spark.range(1).select(schemas.finite(F.lit(1.5))).first()[0] == 1.5
    with pytest.raises(Exception, match="not finite"):
        spark.range(1).select(schemas.finite(F.lit(float("nan")))).collect()


def test_incompatible_steps_bar_older_versions(spark):
    v = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
    family = schemas.Family("invoice", {1: v("total"), 2: v("cents")}, {1: schemas.INCOMPATIBLE})
    df = spark.createDataFrame([(1, '{"total":1}'), (2, '{"cents":5}'), (3, "{}")], "version bigint, payload string")
    got = [(r[0], r[1] and r[1]["cents"]) for r in df.orderBy("version").select(schemas.plan(family, F.col("version")), schemas.migrate(family, F.col("payload"), F.col("version"))).collect()]
    assert got == [("incompatible", None), ("runnable:0", 5), ("newer", None)]


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_serializers_validate():
    from dataclasses import dataclass

    from weftline.functions.serializers import DATACLASS, Registry, Serializer, ValidationError

    @dataclass
    class Inner:
        note: str | None = None

    @dataclass
    class Order:
        quantity: int
        price: float
        inner: list[Inner]
        tags: dict[str, int]

    globals()["Inner"] = Inner
    value = Order(2, 1.5, [Inner("x"), Inner()], {"b": 1, "a": 2})
    data = DATACLASS.encode(value)
    assert data == b'{"inner":[{"note":"x"},{"note":null}],"price":1.5,"quantity":2,"tags":{"a":2,"b":1}}'
    Order.__annotations__ = {"quantity": int, "price": float, "inner": list[Inner], "tags": dict[str, int]}
    assert DATACLASS.decode(data, Order) == value
    for bad in (b'{"quantity":true,"price":1,"inner":[],"tags":{}}', b'{"price":1,"inner":[],"tags":{}}', b'{"quantity":1,"price":1,"inner":[],"tags":{},"x":1}', b"[]"):
        with pytest.raises(ValidationError):
            DATACLASS.decode(bad, Order)
    with pytest.raises(ValueError):
        DATACLASS.encode(Order(1, float("nan"), [], {}))
    registry = Registry()
    registry.add(Serializer("text", lambda t: t is str, str.encode, lambda d, t: d.decode()))
    assert registry.of(Order).name == "dataclass" and registry.of(str).encode("é") == "é".encode()
    with pytest.raises(TypeError):
        registry.of(int)


def test_reducers_are_checked_when_declared():
    def fold(item: int, previous: float) -> float:
        return previous + item

    def other(item: int, previous: int) -> str:
        return str(item)

    assert not bodies.reducer("double")(fold).in_tree and bodies.reducer("bigint", associative=True)(plus).in_tree
    bad = [(other, {}), (fold, {"associative": True}), (plus, {"associative": True, "merge": plus}), (fold, {"tree": True}), (fold, {"merge": plus}), (plus, {"ephemeral": True}), (add, {}), (lambda x: x, {})]
    for function, options in bad:
        with pytest.raises(TypeError):
            bodies.reducer("bigint", **options)(function)


def plus(item: int, previous: int) -> int:
    return item + previous


def test_bodies_that_may_not_be_retried(spark):
    def fails(x):
        raise ValueError("no")

    got = bodies.run(spark.range(1), bodies.task("bigint", retries=3, retriable=False, name="once")(fails), "id").first()["outcome"]
    assert not got["ok"] and got["attempts"] == 1 and bodies.task("bigint", name="once")(fails).title == "once"
    with pytest.raises(ValueError):
        bodies.task("bigint", timeout_s=-1)(fails)
