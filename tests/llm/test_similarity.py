"""Jaccard join, decontamination and components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, decontaminate, jaccard_join
from weftline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))] for _ in range(12)]
    texts = ["", None, " \n", "one", "ONE", "one two", "Ünï one two three", "x " * 50]
    for words in base:
        for _ in range(rng.randrange(1, 9)):
            own = list(words)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append((" " if rng.random() < 0.5 else "\n\t").join(own))
        texts.append(" ".join(words).upper())
    return texts + texts[-3:]


def brute(texts, k, num, den):
    sets, up = [shingles(t, k) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


@pytest.mark.parametrize("seed,k,num,den,task_bytes", [(1, 4, 85, 100, 1 << 24), (2, 5, 80, 100, 1 << 24), (4, 3, 50, 100, 1 << 24), (3, 4, 85, 100, 64), (4, 3, 50, 100, 600)])
def test_components_equal_brute_force(spark, monkeypatch, seed, k, num, den, task_bytes):
    monkeypatch.setattr(jaccard_join, "TASK_BYTES", task_bytes)  # the last two: regions are divided by Spark jobs
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, class string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(df, k, num, den).collect())
    assert got == brute(texts, k, num, den)


def test_one_region_equals_brute_force(monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    for seed in range(8):
        for num in (85, 50):
            texts = corpus(100 + seed)
            sets = jaccard_join.shingle_sets(texts, 2)
            own = {jaccard_join.class_of(h)[0]: h for h in sets if len(h)}
            ids = sorted(own)
            root = jaccard_join.join_region(ids, [own[i] for i in ids], num, 100)
            want = brute(_one_each(texts, sets, ids), 2, num, 100)
            assert [root.index(r) for r in root] == [[w[2] for w in want].index(w[2]) for w in want]


def _one_each(texts, sets, ids):
    of = {jaccard_join.class_of(h)[0]: t for t, h in zip(texts, sets) if len(h)}
    return [of[i] for i in ids]


def mutated(rng, words, n):
    own = list(words)
    for _ in range(n):
        own[rng.randrange(len(own))] = f"m{rng.randrange(10**6)}"
    return " ".join(own)


def test_common_shingles_and_small_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 500)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))  # more than COMMON hold it
    base = [f"b{i}" for i in range(60)]
    texts = [mutated(rng, base, rng.randrange(3)) for _ in range(40)]  # a chain of near copies
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    texts += [passage] * 30 + [f"{passage} one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(df, 4, 85, 100).collect())
    assert got == brute(texts, 4, 85, 100)


def test_sets_of_one_shingle_link(spark):
    df = spark.createDataFrame([(0, "one two three"), (1, "one two three four"), (2, "five")], "doc_id bigint, text string")
    assert sorted(r["component_id"] for r in jaccard_join.similarity_classes(df, 3, 50, 100).collect()) == [0, 0, 2]


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    texts = [" ".join(long), mutated(rng, long, 900), " ".join(long[:30_000]), "a b c d e"]
    names = "doc_id bigint, text string, class int, _w_mark string, region int, _j_id int, mark int"
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in enumerate(texts)], names)
    kept = jaccard_join.keep_one(df, 5, 80, 100)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_scratch_is_removed(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    texts = corpus(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    jaccard_join.similarity_classes(df, 4, 85, 100).count()
    left = {p.rpartition("/weftline-")[2].rpartition("-")[0] for p in set(glob.glob(f"{folder}/*")) - before}
    assert left == {"jaccard-ids", "jaccard-components"}


def test_keep_one_keeps_the_least_of_each_group(spark):
    texts = corpus(7)
    df = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id bigint, text string, mark int")
    got = sorted(r["doc_id"] for r in jaccard_join.keep_one(df, 5, 80, 100).collect())
    assert got == sorted({root for _, _, root in brute(texts, 5, 80, 100)})
    twice = df.unionByName(df)
    assert jaccard_join.keep_one(twice, 5, 80, 100).count() == len(got)


def test_copies_in_other_tasks_are_asked_about_once(spark, monkeypatch):
    seen, cells = [], jaccard_join.cells
    monkeypatch.setattr(jaccard_join, "cells", lambda texts, *a: seen.append(texts.count()) or cells(texts, *a))
    texts = corpus(5) * 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    found = jaccard_join.similarity_classes(df, 4, 85, 100).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["n_shingles"]) == [x for x in brute(texts, 4, 85, 100) if x[1]]
    assert seen[0] <= len({shingles(t, 4) for t in texts}) + 10


def test_a_full_key_filter_loses_no_row(spark, monkeypatch):
    texts = corpus(6) * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(common.KeyFilter, "_slot", lambda self, key: F.pmod(key, F.lit(8).cast("bigint")))
    found = jaccard_join.similarity_classes(df, 4, 85, 100).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["n_shingles"]) == [x for x in brute(texts, 4, 85, 100) if x[1]]


def test_dropped_copies_are_not_joined_again(spark, monkeypatch):
    sizes, sized = [], jaccard_join.sized
    monkeypatch.setattr(jaccard_join, "sized", lambda df: sizes.append(df.count()) or sized(df))
    texts = corpus(8) * 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(r["doc_id"] for r in jaccard_join.keep_one(df, 5, 80, 100).collect())
    assert got == sorted({root for _, _, root in brute(texts, 5, 80, 100)})
    assert sizes[1] < len(texts) // 6  # what an anti join must know: few that pass the filter


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (None, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard_join.similarity_classes(df, 4, 85, 100).collect())
    assert got == [(-1, -1), (-1, 3), (-1, 3), (3, 3)]
    assert jaccard_join.similarity_classes(df.limit(0), 4, 85, 100).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)] + [(200, 200 + i) for i in range(1, 30)]
    up = {x: x for e in edges for x in e}
    for _ in range(len(up)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: r for x, r in up.items() if x != r and x in linked}


def semi_global(p, t):
    before = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        now = [i]
        for j, y in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 45))] for _ in range(12)]
    docs = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        own = list(rng.choice(items))
        for _ in range(rng.randrange(0, 10)):
            at, kind = rng.randrange(len(own)) if own else 0, rng.random()
            own[at : at + 1] = [] if kind < 0.3 else ["new"] if kind < 0.6 else [*own[at : at + 1], "more"]
        docs.append(" ".join([*words, *own, *words[:5]]).upper() + "!")
    docs += ["", None, "?!"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "..")], "item_id bigint, text string")
    want = set()
    for i, t in enumerate(docs):
        for j, w in enumerate(items):
            d = semi_global(w, decontaminate.words_of(t))
            if d <= int(len(w) * decontaminate.RATE):
                want.add((i, j, d))
    for block in (decontaminate.BLOCK_BYTES, 100):
        rows = decontaminate.find_leaks(frame, bench, block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        passage = decontaminate.words_of(docs[r["doc_id"]])[r["first_word"] : r["end_word"]]
        assert semi_global(items[r["item_id"]], passage) == r["distance"]
    clean = {r["doc_id"] for r in decontaminate.without_leaks(frame, bench).collect()}
    assert clean == set(range(len(docs))) - {i for i, *_ in want}
    assert decontaminate.find_leaks(frame.limit(0), bench).count() == decontaminate.find_leaks(frame, bench.limit(0)).count() == 0
