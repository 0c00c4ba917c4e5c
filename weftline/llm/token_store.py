"""Operator 1, token-id output: a content-addressed store of token ids.

Writing: each document's ids are cut where a rolling hash over the last WINDOW ids meets a
mask, so that equal passages give equal chunks wherever they stand. A chunk is named by its
digest and stored once; a document is a recipe, the list of its chunks' digests, under the
Merkle root of that list. Recipes are stored in ascending doc_id order, and each recipe file
has a manifest line: rows, ids, and the Merkle root over its documents' roots.

Files under the store's path (Parquet as container):
  objects/kind=chunk    key (digest), n_ids, payload (ids as little-endian unsigned integers)
  recipes/kind=recipe   doc_id, part, local_start, n_ids, root, chunks (digests)
  recipes/kind=manifest part, n_ids, n_docs, root

Reading checks each chunk against its digest and each recipe against its root. Checksums of
whole documents come from the chunks' own by CRC combination, so that no id moves between
executors; read_documents() gives the ids themselves.

Defined results: null text counts as empty; an empty text is the end id alone; null doc_ids
come first; repeated rows are documents of their own, in the order of (doc_id, content, where
they were read); other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import scratch

#: Ids under the rolling hash; a cut each 2**CUT_BITS ids on average, within the bounds.
WINDOW, CUT_BITS, MIN_CHUNK, MAX_CHUNK = 8, 8, 64, 1024
#: Digests that a writing task remembers so as to send a chunk on once.
SEEN = 500_000

_LONG, _BIN = "bigint", "binary"
_OBJECTS = f"kind string, key {_BIN}, doc_id {_LONG}, n_ids {_LONG}, chunks array<{_BIN}>, payload {_BIN}"
_RECIPES = f"kind string, part {_LONG}, doc_id {_LONG}, local_start {_LONG}, n_ids {_LONG}, n_docs {_LONG}, root {_BIN}, chunks array<{_BIN}>"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over the leaves in order; an odd node goes up as it is; no leaves: digest of nothing."""
    level = [digest(b"\x00" + x) for x in leaves]
    while len(level) > 1:
        level = [digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else digest(b"")


class MerkleStream:
    """merkle_root() of leaves that come one by one, in logarithmic memory."""

    def __init__(self) -> None:
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, digest(b"\x00" + leaf)
        while self.peaks and self.peaks[-1][0] == height:
            node = digest(b"\x01" + self.peaks.pop()[1] + node)
            height += 1
        self.peaks.append((height, node))

    def root(self) -> bytes:
        if not self.peaks:
            return digest(b"")
        node = self.peaks[-1][1]
        for _, left in reversed(self.peaks[:-1]):
            node = digest(b"\x01" + left + node)
        return node


_mix = np.random.default_rng(11).integers(1, 1 << 62, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    value = _mix[ids & 0xFFFF] ^ (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rolling = value.copy()
    for k in range(1, WINDOW):
        rolling[k:] += value[:-k] << np.uint64(k)
    candidates = np.flatnonzero((rolling >> np.uint64(40)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1
    ends, at, k = [], 0, 0
    while n - at > MIN_CHUNK:
        k = int(np.searchsorted(candidates, at + MIN_CHUNK))
        end = int(candidates[k]) if k < len(candidates) else n
        at = min(end, at + MAX_CHUNK, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _payload(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, marked by the first byte."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def decode_payload(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, dtype=f"<u{payload[0]}", offset=1).astype("<u4")


def _chunked(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = tokens.encoder(path), set()
        schema = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("chunks", pa.list_(pa.binary())), ("payload", pa.binary())])
        for batch in batches:
            doc_ids, texts, where = (batch.column(k).to_pylist() for k in range(3))
            for lo, hi in tokens.blocks(texts):
                ids, offsets = enc.encode(texts[lo:hi])
                rows = []
                for k in range(lo, hi):
                    own = ids[offsets[k - lo] : offsets[k - lo + 1]]
                    at, names = 0, []
                    for end in cut_points(own):
                        data = _payload(own[at:end])
                        name = digest(data)
                        names.append(name)
                        if name not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(name)
                            rows.append(("chunk", name, None, end - at, None, data))
                        at = end
                    rows.append(("recipe", where[k].to_bytes(8, "big"), doc_ids[k], len(own), names, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of one range of doc_ids in order, then their manifest line."""
    from pyspark import TaskContext

    part, start, n_docs, tree = TaskContext.get().partitionId(), 0, 0, MerkleStream()
    for batch in batches:
        n = batch.column("n_ids").to_numpy()
        chunks = batch.column("chunks")
        roots = [merkle_root(c) for c in chunks.to_pylist()]
        for r in roots:
            tree.add(r)
        m = len(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["recipe"] * m), pa.array([part] * m, pa.int64()), batch.column("doc_id"), pa.array(start + np.cumsum(n) - n), batch.column("n_ids"), pa.array([1] * m, pa.int64()), pa.array(roots, pa.binary()), chunks],
            names=["kind", "part", "doc_id", "local_start", "n_ids", "n_docs", "root", "chunks"],
        )
        start, n_docs = start + int(n.sum()), n_docs + m
    if n_docs:
        yield pa.RecordBatch.from_pydict(
            {"kind": ["manifest"], "part": [part], "doc_id": [None], "local_start": [None], "n_ids": [start], "n_docs": [n_docs], "root": [tree.root()], "chunks": [None]},
            schema=pa.schema([("kind", pa.string()), ("part", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("root", pa.binary()), ("chunks", pa.list_(pa.binary()))]),
        )


def write_store(docs: DataFrame, store: str, tokenizer: str | None = None) -> None:
    """Encode docs (doc_id, text) into a store at a path that does not exist yet."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text"), F.monotonically_increasing_id().alias("_where"))
    made = rows.mapInArrow(_chunked(tokenizer or tokens.default_path()), _OBJECTS)
    made.dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{store}/objects")
    spark = docs.sparkSession
    recipes = spark.read.schema(_OBJECTS).parquet(f"{store}/objects").where("kind = 'recipe'").select("doc_id", "key", "n_ids", "chunks")
    ordered = recipes.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    ordered.mapInArrow(_ordered, _RECIPES).write.partitionBy("kind").parquet(f"{store}/recipes")


def recipes(spark: SparkSession, store: str) -> DataFrame:
    """Recipes with start: the ids of all documents before, by the manifest's running sums."""
    table = spark.read.schema(_RECIPES).parquet(f"{store}/recipes")
    lines = sorted((r.part, r.n_ids) for r in table.where("kind = 'manifest'").select("part", "n_ids").collect())  # one a file
    sums = np.concatenate([[0], np.cumsum([n for _, n in lines])]) if lines else [0]
    offsets = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(lines, sums, strict=False)], "part bigint, before bigint")
    return table.where("kind = 'recipe'").join(F.broadcast(offsets), "part").select("part", "doc_id", "local_start", (F.col("before") + F.col("local_start")).alias("start"), "n_ids", "root", "chunks")


@lru_cache(maxsize=4096)
def _shift(n_bytes: int) -> tuple[int, ...]:
    """What n_bytes zero bytes do to each bit of a CRC register, as a matrix over GF(2)."""
    if n_bytes == 1:
        op = []
        for bit in range(32):
            x = 1 << bit
            for _ in range(8):
                x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
            op.append(x)
        return tuple(op)
    half = _shift(n_bytes // 2)
    twice = tuple(_apply(half, x) for x in half)
    return twice if n_bytes % 2 == 0 else tuple(_apply(_shift(1), x) for x in twice)


def _apply(op: tuple[int, ...], x: int) -> int:
    out = 0
    while x:
        low = x & -x
        out ^= op[low.bit_length() - 1]
        x ^= low
    return out


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of the concatenation of parts given as (crc32, bytes)."""
    crc = 0
    for c, n in parts:
        crc = _apply(_shift(n), crc) ^ c if n else crc
    return crc


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts, payloads = (batch.column(k).to_pylist() for k in range(3))
        crcs = []
        for key, n, payload in zip(keys, counts, payloads, strict=True):
            ids = decode_payload(payload)
            if digest(payload) != key or len(ids) != n:
                raise ValueError(f"chunk {key.hex()} is damaged")
            crcs.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["key", "n", "crc"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, start, n_ids, root, found = (batch.column(k).to_pylist() for k in range(5))
        crcs = []
        for k in range(len(root)):
            own = sorted((c["pos"], c["key"], c["n"], c["crc"]) for c in found[k])
            if any(c[2] is None for c in own):
                raise ValueError(f"document {doc_id[k]}: a chunk is missing")
            if merkle_root([c[1] for c in own]) != root[k] or sum(c[2] for c in own) != n_ids[k]:
                raise ValueError(f"document {doc_id[k]}: its recipe is damaged")
            crcs.append(crc32_joined([(c[3], 4 * c[2]) for c in own]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64()), pa.array([len(f) for f in found], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])


def _placed(spark: SparkSession, store: str) -> DataFrame:
    return recipes(spark, store).select("part", "local_start", "doc_id", "start", "n_ids", "root", F.posexplode("chunks").alias("pos", "key"))


def verify_documents(spark: SparkSession, store: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, n_chunks, all read and checked from the files."""
    objects = spark.read.schema(_OBJECTS).parquet(f"{store}/objects").where("kind = 'chunk'")
    chunks = objects.select("key", "n_ids", "payload").mapInArrow(_verified, "key binary, n bigint, crc bigint")
    placed = _placed(spark, store).join(chunks, "key", "left")
    whole = placed.groupBy("part", "local_start", "doc_id", "start", "n_ids", "root").agg(F.collect_list(F.struct("pos", "key", "n", "crc")).alias("found"))
    return whole.select("doc_id", "start", "n_ids", "root", "found").mapInArrow(_joined, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, n_chunks bigint")


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """Per document: doc_id, start, ids (array), put together from the store."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([decode_payload(c["payload"]) for c in sorted(f, key=lambda c: c["pos"])]).astype(np.int64) for f in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    objects = spark.read.schema(_OBJECTS).parquet(f"{store}/objects").where("kind = 'chunk'")
    placed = _placed(spark, store).join(objects.select("key", "payload"), "key")
    whole = placed.groupBy("part", "local_start", "doc_id", "start").agg(F.collect_list(F.struct("pos", "payload")).alias("found"))
    return whole.select("doc_id", "start", "found").mapInArrow(put, "doc_id bigint, start bigint, ids array<bigint>")


def token_store(docs: DataFrame, store: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write a store and read it back: a row for each document, as in verify_documents()."""
    spark = docs.sparkSession
    store = store or scratch(spark, "tokens")
    write_store(docs, store, tokenizer)
    return verify_documents(spark, store)
