"""Packing over several blocks: every block is packed by tiers."""

import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark

from weftline.llm import packing, tokens


def test_inner_blocks_use_the_tiers_that_a_last_one_does():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(5, 1, 4000).astype(int) + 1, 30000).tolist()
    whole, _ = packing.pack_lengths(lengths)
    inner, rest = packing.pack_lengths(lengths, last=False)
    ids = lambda done: Counter({t: sum(n for _, ps in done if _ == t for *_, n in ps) for t in packing.TIERS})
    assert sum(ids(inner).values()) + sum(n for *_, n in rest) == sum(lengths)
    assert sum(n for *_, n in rest) < 2048 and all(sum(n for *_, n in ps) == t for t, ps in inner)
    assert inner == whole[: len(inner)] and min(ids(inner)[t] for t in packing.TIERS[1:-1]) > 0


def test_several_flushes_lose_nothing_and_keep_tiers(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_DOCS", 40)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], n)) for n in np.minimum(rng.lognormal(4, 1.2, 400).astype(int), 5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 20), pa.int64()), pa.array(texts[k : k + 20])], names=["doc_id", "text"]) for k in range(0, 400, 20)]
    flushes = [b.to_pylist() for b in packing._packed(tokens.default_path(), packing.TIERS)(iter(batches))]
    assert len(flushes) > 5
    # texts of some 100 words belong in the shorter tiers, in inner blocks too
    inner = [r for rows in flushes[:-1] for r in rows]
    assert {r["tier"] for r in inner} == set(packing.TIERS)
    assert sum(r["length"] for r in inner if r["tier"] < 2048) > 0.5 * sum(r["length"] for r in inner)
    ids, at = tokens.encoder(tokens.default_path()).encode(texts)
    for d in range(400):
        own = sorted((r for rows in flushes for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        mine = ids[at[d] : at[d + 1]]
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1]) and sum(r["length"] for r in own) == len(mine)
        assert all(r["ids_crc32"] == zlib.crc32(mine[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) for r in own)


def test_tier_shares_do_not_follow_the_block():
    rng = np.random.default_rng(6)
    lengths = np.minimum(rng.lognormal(5, 1, 6000).astype(int) + 1, 30000).tolist()

    def shares(block):
        ids, total = Counter(), 0
        for k in range(0, len(lengths), block):
            for tier, pieces in packing.pack_lengths(lengths[k : k + block])[0]:
                ids[tier] += sum(n for *_, n in pieces)
        return np.array([ids[t] / sum(lengths) for t in packing.TIERS])

    assert np.abs(shares(6000) - shares(1000)).max() < 0.05 and np.abs(shares(6000) - shares(300)).max() < 0.08
