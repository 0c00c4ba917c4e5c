"""Operator 4, token counts by offset-mapped attribution.

Each document is encoded once, whole, with a byte-level vocabulary; its tokens' byte lengths
add up to byte spans, and these map to character spans. Sections are character spans too; both
lists are sorted, so the interval join of a document is two binary searches for all its tokens.

A token inside one section counts there. A token that crosses a boundary is allocated by
rule: "start" gives it to the section of its first character in any section; "majority" to
the section with most of its characters, the earlier one of two; "split" gives each section
its share of characters. Tokens in no section count as outside, so that sections and outside
together always make up the document's tokens.

Defined results: null text counts as empty; an empty text has no tokens and no sections;
null doc_ids stay null; repeated rows give rows of their own; other columns are ignored; an
empty table gives no rows. Sections are expected sorted and disjoint.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, n_outside double, section_tokens array<double>"
RULES = ("start", "majority", "split")

_encodings: dict[str, tuple] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(path: str):
    """(encoding, bytes of each id) of a vocabulary of ranks, once for each process."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, rank in ranks.items():
            sizes[rank] = len(piece)
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[path]


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token; a token of part of a character spans it."""
    encoding, sizes = _encoding(path)
    ends = np.cumsum(sizes[encoding.encode_to_numpy(text, disallowed_special=())])
    if not len(ends):
        return ends, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[np.append(0, ends[:-1])], char[ends - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feed: spans that cover the whole text."""
    ends = np.cumsum([len(x) for x in text.split("\n")]) + np.arange(1, text.count("\n") + 2)
    ends[-1] -= 1
    starts = np.append(0, ends[:-1])
    return starts[starts < ends], ends[starts < ends]


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, float, int]:
    """(tokens of each section, tokens outside, tokens crossing a boundary)."""
    counts = np.zeros(len(starts))
    if not len(first):
        return counts, 0.0, 0
    lo = np.searchsorted(ends, first, side="right")  # first section that ends after the token's start
    hi = np.searchsorted(starts, end, side="left")  # sections that start before its end
    if not len(starts):
        return counts, float(len(first)), 0
    inside = (hi == lo + 1) & (starts[np.minimum(lo, len(starts) - 1)] <= first) & (end <= ends[np.minimum(lo, len(starts) - 1)])
    np.add.at(counts, lo[inside], 1.0)
    outside, crossing = float((hi <= lo).sum()), 0
    for k in np.flatnonzero(~inside & (hi > lo)):
        crossing += 1
        overlaps = np.minimum(end[k], ends[lo[k] : hi[k]]) - np.maximum(first[k], starts[lo[k] : hi[k]])
        if rule == "start":
            counts[lo[k]] += 1
        elif rule == "majority":
            counts[lo[k] + int(np.argmax(overlaps))] += 1
        else:
            share = overlaps / (end[k] - first[k])
            counts[lo[k] : hi[k]] += share
            outside += 1 - float(share.sum())
    return counts, outside, crossing


def _counted(path: str, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                text = batch.column(1)[k].as_py() or ""
                first, end = token_spans(text, path)
                if given:
                    spans = batch.column(2)[k].as_py() or []
                    starts, ends = np.array([s["start"] for s in spans], dtype=np.int64), np.array([s["end"] for s in spans], dtype=np.int64)
                else:
                    starts, ends = line_sections(text)
                counts, outside, crossing = attribute(first, end, starts, ends, rule)
                rows.append((doc_id, len(first), len(starts), crossing, outside, counts.tolist()))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "n_outside", "section_tokens"])

    return run


def count_tokens(docs: DataFrame, rule: str = "majority", sections: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Tokens of each document and of its sections: its lines, or the spans in column sections (array of start, end)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *([F.col(sections).alias("_spans")] if sections else []))
    return rows.mapInArrow(_counted(vocabulary or default_path(), rule, sections is not None), SCHEMA)
