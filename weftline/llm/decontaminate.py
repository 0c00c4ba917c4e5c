"""Operator 2, benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words. An item of L words may differ by k = floor(L * rate)
word edits. It is cut into k + 1 pieces; whatever k edits do, one piece stays whole, so each
passage within the budget holds an exact piece hit. Pieces are found with one automaton over
the whole text, and Myers's bit-parallel distance verifies the window around each hit.

An item of fewer than five words has no edit to spare and is found wherever its words stand in a
row, one of a single word in every document that has it: such pairs are the result asked for, and
whoever doesn't want them leaves short items out of the benchmark.

Items are sent to the workers in blocks of bounded size, one pass over the documents for each
block, so a benchmark of any size is matched exactly.

Defined results: null text and texts without words match nothing; items without words are
never found; null ids are kept as null; a repeated document or item gives rows of its own;
of several passages in one document the nearest, then the first, is reported; other columns
are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word edits allowed for each word of an item.
RATE = 0.2
#: Bytes of items sent to the workers at once.
BLOCK_BYTES = 16 << 20

WORD = re.compile(r"\w+")
SCHEMA = "doc_id bigint, item_id bigint, distance bigint, budget bigint, first_word bigint, end_word bigint"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """(start, words) of budget + 1 pieces of nearly equal length."""
    n, m = len(words), budget + 1
    cuts = [i * n // m for i in range(m + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Item:
    """An item ready for Myers's algorithm: a bit mask for each of its words."""

    def __init__(self, item_id: int | None, words: list[str], rate: float):
        self.item_id, self.words, self.size = item_id, words, len(words)
        self.budget = int(len(words) * rate)
        self.masks: dict[str, int] = defaultdict(int)
        for i, w in enumerate(words):
            self.masks[w] |= 1 << i
        self.masks = dict(self.masks)

    def nearest(self, text: list[str]) -> tuple[int, int]:
        """(least distance of a passage of text, its end): the first end with that distance."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        pv, mv, score = full, 0, self.size
        best, end = self.size, 0
        for j, w in enumerate(text):
            eq = self.masks.get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) & full  # a passage may start anywhere: no cost on the left edge
            mh = (mh << 1) & full
            pv = mh | (~(xv | ph) & full)
            mv = ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end

    def starts(self, text: list[str], end: int, distance: int) -> int:
        """Where the passage that ends at end with that distance starts: the last such place."""
        back = Item(self.item_id, self.words[::-1], 0)
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        pv, mv, score = full, 0, self.size
        for j, w in enumerate(reversed(text[:end])):
            eq = back.masks.get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            score += 1 if ph & top else -1 if mh & top else 0
            ph = ((ph << 1) | 1) & full  # anchored: each word left out costs one
            mh = (mh << 1) & full
            pv = mh | (~(xv | ph) & full)
            mv = ph & xv
            if score == distance:
                return end - j - 1
        return end


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float):
        import ahocorasick

        self.items = [Item(i, w, rate) for i, t in items if (w := words_of(t))]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, item in enumerate(self.items):
            for start, own in pieces(item.words, item.budget):
                found[f" {' '.join(own)} "].append((k, start))
        self.automaton = ahocorasick.Automaton()
        for piece, at in found.items():
            self.automaton.add_word(piece, (len(piece), at))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def match(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item_id, distance, budget, first word, end word) of each item in the text."""
        words = words_of(text)
        if self.empty or not words:
            return []
        joined = f" {' '.join(words)} "
        hits: dict[int, set[int]] = defaultdict(set)
        word_at: dict[int, int] | None = None
        for last, (n, at) in self.automaton.iter(joined):
            if word_at is None:  # places of the words, only in texts with hits
                word_at, place = {}, 0
                for i, w in enumerate(words):
                    word_at[place] = i
                    place += len(w) + 1
            here = word_at[last - n + 1]
            for k, start in at:
                hits[k].add(here - start)
        out = []
        for k, diagonals in hits.items():
            item, best = self.items[k], None
            lo = hi = None
            windows = []
            for d in sorted(diagonals):
                a, b = max(d - item.budget, 0), min(d + item.size + item.budget, len(words))
                if hi is not None and a <= hi:
                    hi = max(hi, b)
                else:
                    if hi is not None:
                        windows.append((lo, hi))
                    lo, hi = a, b
            windows.append((lo, hi))
            for a, b in windows:
                distance, end = item.nearest(words[a:b])
                if distance <= item.budget and (best is None or distance < best[0]):
                    best = (distance, a + item.starts(words[a:b], end, distance), a + end)
            if best:
                out.append((item.item_id, best[0], item.budget, best[1], best[2]))
        return out


_matchers: dict[str, Matcher] = {}


def _scan(items: list[tuple[int | None, str | None]], rate: float, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _matchers:
            _matchers.clear()
            _matchers[name] = Matcher(items, rate)
        matcher = _matchers[name]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc_id, *m) for m in matcher.match(text.as_py())]
            names = ["doc_id", "item_id", "distance", "budget", "first_word", "end_word"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document (doc_id, text) and item (item_id, text) that it holds within the budget."""
    import uuid

    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    found = None
    for k in range(n_blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()]  # bounded by block_bytes
        part = rows.mapInArrow(_scan(block, rate, uuid.uuid4().hex), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows that hold an item within the budget; all columns stay, null doc_ids too."""
    import uuid

    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(n_blocks):
        block = [tuple(r) for r in benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).select(F.col("item_id").cast("bigint"), "text").collect()]  # bounded by BLOCK_BYTES
        name = uuid.uuid4().hex

        def clean(batches: Iterator[pa.RecordBatch], block=block, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _matchers:
                _matchers.clear()
                _matchers[name] = Matcher(block, rate)
            matcher = _matchers[name]
            for batch in batches:
                yield batch.filter(pa.array([not matcher.match(t.as_py()) for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
