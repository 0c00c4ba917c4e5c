"""Token store, packing and token counts against the libraries themselves."""

import zlib

import numpy as np
import pytest

from weftline.llm import packing, token_counts, token_store, tokens
from weftline.llm.common import scratch

TEXTS = ["", None, "  \n", "A plain text, it's 1234 words.\nAnother line!!", "a<|endoftext|>b", "Ünïcödé ΑΣ İ ½ ³ don't \xa0x\x85y\x1cz", "漢字 😀😀", "word " * 3000, "same same same", "same same same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 3 else k, t, "other", k) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, part int").repartition(3)


@pytest.fixture(scope="module")
def ids():
    t = tokens.encoder(tokens.default_path()).tokenizer
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4") for x in TEXTS]


def test_encoder_equals_library(ids):
    e = tokens.PieceEncoder(tokens.default_path(), cache_pieces=5)
    for _ in range(2):
        got, at = e.encode(TEXTS)
        assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [x.tolist() for x in ids]


def test_store_round_trip(spark, docs, ids):
    path = scratch(spark, "test-store")
    rows = token_store.token_store(docs, path).orderBy("start").collect()
    order = sorted(range(len(TEXTS)), key=lambda k: (k != 3, k))  # the null doc_id first
    assert [r["doc_id"] for r in rows] == [None if k == 3 else k for k in order]
    start = 0
    for r, k in zip(rows, order):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        start += len(ids[k])
    whole = {r["start"]: r["ids"] for r in token_store.read_documents(spark, path).collect()}
    assert [whole[r["start"]] for r in rows] == [ids[k].tolist() for k in order]
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()


def test_damage_is_found():
    payload = token_store._payload(np.arange(5, dtype=np.uint32))
    assert token_store.decode_payload(payload).tolist() == [0, 1, 2, 3, 4]
    big = np.array([1, 70000], dtype=np.uint32)
    assert token_store.decode_payload(token_store._payload(big)).tolist() == [1, 70000]
    stream = token_store.MerkleStream()
    for n in range(1, 20):
        stream.add(bytes([n]))
        assert stream.root() == token_store.merkle_root([bytes([k]) for k in range(1, n + 1)])
    data = np.random.default_rng(1).bytes(1000)
    for cuts in ((10, 500), (1, 2, 3, 999), (0, 1000)):
        parts = [data[a:b] for a, b in zip((0, *cuts), (*cuts, 1000))]
        assert token_store.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


def test_cut_points_follow_content():
    ids = np.random.default_rng(2).integers(0, 49000, 20000).astype(np.uint32)
    a, b = token_store.cut_points(ids), token_store.cut_points(np.concatenate([ids[:5000], [7, 8, 9], ids[5000:]]))
    assert a[-1] == len(ids) and all(y - x <= token_store.MAX_CHUNK for x, y in zip([0, *a], a))
    chunks = lambda seq, ends: {seq[x:y].tobytes() for x, y in zip([0, *ends], ends)}
    longer = np.concatenate([ids[:5000], np.array([7, 8, 9], dtype=np.uint32), ids[5000:]])
    assert len(chunks(ids, a) - chunks(longer, b)) <= 6


def test_packing_is_exact(docs, ids):
    rows = packing.pack(docs).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    left = [x.tolist() for x in ids]
    for (doc_id, total), own in by_doc.items():
        k = 3 if doc_id is None else doc_id
        own.sort(key=lambda r: r["start"])
        assert total == len(ids[k]) and [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        assert all(r["ids_crc32"] == zlib.crc32(ids[k][r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
        left[k] = []
    assert not any(left)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        assert sum(r["length"] for r in own) <= own[0]["tier"] <= 2048


def test_packing_pads_little():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, 30000).tolist()
    done, rest = packing.pack_lengths(lengths)
    assert not rest and sum(n for _, ps in done for *_, n in ps) == sum(lengths)
    assert sum(tier - sum(n for *_, n in ps) for tier, ps in done) < 64
    groups = packing.step_groups(done)
    assert max(np.bincount(groups)) <= packing.GROUP
    with pytest.raises(ValueError):
        packing.pack(None, tiers=(100, 200))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, docs, rule):
    encoding, sizes = token_counts._encoding(token_counts.default_path())
    for r in token_counts.count_tokens(docs, rule).collect():
        text = TEXTS[3 if r["doc_id"] is None else r["doc_id"]] or ""
        found = encoding.encode_ordinary(text)
        assert r["n_tokens"] == len(found) and abs(sum(r["section_tokens"]) + r["n_outside"] - len(found)) < 1e-6
        # brute force: the section of every character, and the characters of every token
        section = [k for k, line in enumerate(text.splitlines(keepends=True) if "\x85" not in text and "\x1c" not in text else [x + "\n" for x in text.split("\n")]) for _ in line]
        want, at, chars = [0.0] * r["n_sections"], 0, []
        for k, c in enumerate(text):
            chars += [k] * len(c.encode())
        for t in found:
            own = sorted({chars[b] for b in range(at, at + sizes[t])})
            at += int(sizes[t])
            hit = [section[c] for c in own]
            if rule == "start":
                want[hit[0]] += 1
            elif rule == "majority":
                want[max(sorted(set(hit)), key=hit.count)] += 1
            else:
                for s in hit:
                    want[s] += 1 / len(hit)
        assert np.allclose(want, r["section_tokens"])


def test_given_sections_leave_tokens_outside(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma", [(6, 10)])], "doc_id bigint, text string, s array<struct<start:int,end:int>>")
    r = token_counts.count_tokens(df, sections="s").first()
    assert r["n_sections"] == 1 and r["n_outside"] >= 1 and sum(r["section_tokens"]) + r["n_outside"] == r["n_tokens"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_store.token_store(none).count() == packing.pack(none).count() == token_counts.count_tokens(none).count() == 0


def test_other_tokenizer_files_are_refused():
    other = tokens.default_path().replace("word_bpe_49k", "byte_bpe_50k")
    with pytest.raises(ValueError, match="another way"):
        tokens.encoder(other)
