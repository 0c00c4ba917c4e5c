"""Operator 3, hierarchical multi-length packing.

Tiers are context sizes, powers of two up to the longest. Whole windows of the longest size
are cut off long documents first. What remains of each document is routed to the shortest
tier that holds it. Tiers are packed from the longest down: a window opens with the longest
document waiting in its tier, its gap is filled best-fit with whole documents of that and
shorter tiers, and what gap then remains is closed by cutting one piece off a shorter
document, whose rest is routed anew. Full windows have no padding; what is left at the end
of a task is cut along the tiers and only a rest below the shortest is padded.

Each input task packs its own documents in blocks, so nothing is shuffled, memory is bounded
by a block and a lost task is packed again alike. Every block is packed by tiers; as gaps are
closed from all shorter tiers, one window of a block at most stays open and joins the next. Sequences are dealt to step groups so that
each group of GROUP windows of a tier has about the same attention cost.

Defined results: null text counts as empty; every document has its end id, so an empty one
is one token; null doc_ids stay null; repeated rows are documents of their own; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Context sizes, shortest first.
TIERS = (64, 128, 256, 512, 1024, 2048)
#: Documents and ids packed together.
BLOCK_DOCS, BLOCK_IDS = 16_384, 4_000_000
#: Windows of a tier in a step group.
GROUP = 16

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint"

Piece = tuple[int, int, int]  # document, start, length


class _Waiting:
    """A list of pieces (length, document, start) for each tier, by length; a piece waits in the shortest tier that holds it."""

    def __init__(self, tiers: tuple[int, ...], pieces: list[tuple[int, int, int]]):
        self.tiers, self.lists = tiers, [[] for _ in tiers]
        for piece in sorted(pieces):
            self.lists[self.route(piece[0])].append(piece)

    def route(self, n: int) -> int:
        return bisect_left(self.tiers, n)

    def put(self, piece: tuple[int, int, int]) -> None:
        insort(self.lists[self.route(piece[0])], piece)

    def longest(self, gap: int) -> tuple[int, int, int] | None:
        """The longest piece that fits a gap, from the gap's own tier or the next shorter ones."""
        for own in self.lists[self.route(gap) :: -1]:
            k = bisect_right(own, (gap, 1 << 62, 1 << 62)) - 1
            if k >= 0:
                return own.pop(k)
        return None

    def shortest(self) -> tuple[int, int, int] | None:
        return next((own.pop(0) for own in self.lists if own), None)


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(sequences as (tier, pieces), pieces left over). Without last, the one window that nothing is left to fill is left over."""
    longest = tiers[-1]
    done: list[tuple[int, list[Piece]]] = []
    rests = []
    for d, n in enumerate(lengths):
        whole = n // longest
        done += [(longest, [(d, k * longest, longest)]) for k in range(whole)]
        if n % longest:
            rests.append((n % longest, d, whole * longest))
    waiting = _Waiting(tiers, rests)
    for at in range(len(tiers) - 1, -1, -1):  # tier by tier; what is routed anew is shorter and waits in this tier or below
        size = tiers[at]
        while waiting.lists[at]:
            gap, pieces = size, []
            while gap:
                if found := waiting.longest(gap):
                    n, d, s = found
                    pieces.append((d, s, n))
                    gap -= n
                elif found := waiting.shortest():  # nothing fits: cut
                    n, d, s = found
                    pieces.append((d, s, gap))
                    waiting.put((n - gap, d, s + gap))
                    gap = 0
                else:
                    break
            if not gap:
                done.append((size, pieces))
            elif not last:
                return done, pieces
            else:
                done += _laddered(pieces, tiers)
    return done, []


def _laddered(pieces: list[Piece], tiers: tuple[int, ...]) -> list[tuple[int, list[Piece]]]:
    """The last pieces cut along the tiers; a rest below the shortest tier makes a padded sequence."""
    out, total = [], sum(p[2] for p in pieces)
    while total:
        size = next((t for t in reversed(tiers) if t <= total), tiers[0])
        own, gap = [], size
        while gap and pieces:
            d, s, n = pieces[0]
            take = min(n, gap)
            own.append((d, s, take))
            gap -= take
            pieces[0] = (d, s + take, n - take)
            if take == n:
                pieces.pop(0)
        out.append((size, own))
        total -= size - gap
    return out


def step_groups(sequences: list[tuple[int, list[Piece]]], group: int = GROUP) -> list[int]:
    """A group for each sequence: windows of one tier, dealt by falling attention cost to and fro."""
    out, first = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}):
        own = sorted((k for k, (t, _) in enumerate(sequences) if t == tier), key=lambda k: (-sum(n * n for _, _, n in sequences[k][1]), k))
        n = -(-len(own) // group)
        for i, k in enumerate(own):
            lap, at = divmod(i, n)
            out[k] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return out


def _packed(path: str, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.encoder(path)
        base = TaskContext.get().partitionId() << 40
        sequence = groups = 0
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, ids of it before, its tokens, ids
        n_held = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, n_held, sequence, groups
            done, rest = pack_lengths([len(h[3]) for h in held], tiers, last)
            rows = []
            of = step_groups(done)
            for (tier, pieces), g in zip(done, of, strict=True):
                offset = 0
                for d, s, n in pieces:
                    doc_id, before, total, ids = held[d]
                    rows.append((doc_id, before + s, n, zlib.crc32(ids[s : s + n].astype("<u4").tobytes()), total, base + sequence, offset, tier, base + groups + g))
                    offset += n
                sequence += 1
            groups += max(of, default=-1) + 1
            held = [(held[d][0], held[d][1] + s, held[d][2], held[d][3][s : s + n]) for d, s, n in rest]
            n_held = sum(len(h[3]) for h in held)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names) if rows else None

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in tokens.blocks(texts):
                ids, offsets = enc.encode(texts[lo:hi])
                for k in range(lo, hi):
                    own = ids[offsets[k - lo] : offsets[k - lo + 1]]
                    held.append((doc_ids[k], 0, len(own), own))
                    n_held += len(own)
                if (len(held) >= BLOCK_DOCS or n_held >= BLOCK_IDS) and (out := flush(last=False)):
                    yield out
        if held and (out := flush(last=True)):
            yield out

    return run


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of docs (doc_id, text): which ids of the document stand where in which sequence."""
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are rising powers of two")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(_packed(tokenizer or tokens.default_path(), tuple(tiers)), SCHEMA)
