"""The registered queries over the small tables, against brute force."""

import collections
import hashlib
import re
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

from tests.llm.test_rules_and_spans import PATTERNS, base, valid
from tests.llm.test_similarity import brute
from weftline.llm import queries, tokens


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(tokens.default_path())
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in docs}


def packed(own):
    return b"".join(i.to_bytes(4, "little") for i in own)


def test_op1(spark, sf, docs, ids):
    at = 0
    for r in sorted(queries.op1_token_store(spark, sf).collect(), key=lambda r: r["doc_id"]):
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(packed(own)))
        at += len(own)
    assert at == sum(map(len, ids.values()))


def test_op3(spark, sf, ids):
    sequences, covered = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op3_packing(spark, sf).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(packed(own)) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]].append((r["start"], r["length"]))
    for spans, total in [*((s, None) for s in sequences.values()), *((covered[d], len(own)) for d, own in ids.items())]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 2048


def test_op5(spark, sf, docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op5_jaccard_join(spark, sf).collect())
    assert got == [(docs[i][0], n, docs[root][0]) for i, n, root in brute([t for _, t in docs], 4, 85, 100)]


def test_op6_and_op8_bases(spark, sf, docs):
    texts = dict(docs)
    for r in queries.op6_quality_rules(spark, sf).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(texts[r["doc_id"]])
    for r in queries.op8_personal_data(spark, sf).collect():
        text = texts[r["doc_id"]] or ""
        own = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if valid(k, m.group())] for k, p in PATTERNS]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(x) for x in own]
        assert r["base_sha256"] == hashlib.sha256(",".join(sum(own, [])).encode()).hexdigest()
        assert r["spans"].count("secret:") == len(re.findall(r"AKIA[A-Z0-9]{16}|(?:password=|token = \")[0-9a-f]{18,40}", text))


def test_op7(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    rows = queries.op7_warc(spark, sf)
    found = con.execute(queries.oracle_sql()["op7_warc"])
    order = [d[0] for d in found.description]
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in rows.collect()))) == sorted(map(repr, found.fetchall()))


def test_op9_op10(spark, sf, docs):
    want = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    rows = queries.op9_sharding(spark, sf).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    rows = queries.op10_quality_classifier(spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == len(docs) and sum(right) > 0.9 * len(right)
