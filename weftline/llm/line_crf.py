"""Operator 10, document quality by a linear-chain conditional random field over lines.

Every line has measures of its own (lengths, capitals, digits, signs, repeated words, place)
and those of the lines before and after it. A chain of two states, bad and good, with
transition weights runs over a document's lines; forward-backward gives each line's marginal,
and a document's score is their mean weighted by line length.

Training takes TRAIN_DOCS labelled documents of each class at most, drawn by hash from rows
whose crc32(doc_id as text) mod 3 is not 1, of at most TRAIN_LINES lines; each line takes its
document's label. Only line measures go to the driver. labels, lang, source and doc_id are
never features. Scoring runs over whole texts of all documents.

Defined results: null and empty texts are one empty line, scored like any other; without any
labelled row every score is 0.5; null doc_ids are not held out; labels that are null or of an
unknown document are ignored, a document labelled twice is used twice; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Labelled documents of each class, and lines of one, that training takes at most.
TRAIN_DOCS, TRAIN_LINES = 2000, 300
STEPS, RATE, DECAY = 150, 0.1, 1e-3
FOLDS, HELD_OUT = 3, 1

_ROLE = np.zeros(256, dtype=np.uint8)  # 0: letter or other, 1: space, 2: capital, 3: digit, 4: stop, 5: sign, 6: ! or ?, 7: bar
_ROLE[[9, 11, 12, 13, 32]] = 1
_ROLE[ord("A") : ord("Z") + 1] = 2
_ROLE[ord("0") : ord("9") + 1] = 3
_ROLE[[ord(c) for c in ".,;:'\"()-"]] = 4
_ROLE[[ord(c) for c in "#*$%&<>@^~_=+/\\{}[]`"]] = 5
_ROLE[[ord(c) for c in "!?"]] = 6
_ROLE[ord("|")] = 7
_WORD = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

OWN = 14
FEATURES = 3 * OWN + 1


def line_measures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures of all lines, lines of each text, bytes of each line)."""
    raw = [(t or "").encode() + b"\n" for t in texts]
    b = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.flatnonzero(b == 10)
    starts = np.append(0, ends[:-1] + 1)
    text_ends = np.cumsum([len(r) for r in raw])
    line_of_text = np.searchsorted(ends, text_ends - 1) + 1
    n_lines = np.diff(np.append(0, line_of_text))
    role = _ROLE[b]
    size = ends - starts
    full = np.maximum(size, 1)

    def count(flag: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(flag))
        return c[ends] - c[starts]

    blank = (role == 1) | (b == 10)
    first = ~blank
    first[1:] &= blank[:-1]
    last = ~blank[:-1] & blank[1:]
    last = np.append(last, False)
    words = count(first)
    per_word = np.maximum(words, 1)
    letters = np.maximum(count((role == 0) & ~blank) + count(role == 2), 1)
    again, twice = np.zeros(len(starts)), np.zeros(len(starts))
    at = np.flatnonzero(first)
    if len(at):
        n = np.flatnonzero(last) + 1 - at
        out = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(out, n)
        h = np.add.reduceat(_WORD[b[inside + np.repeat(at, n)]] * (np.uint64(2) * inside.astype(np.uint64) + np.uint64(1)), out) + n.astype(np.uint64)
        line = np.searchsorted(ends, at)
        for back, to in ((1, again), (2, twice)):
            same = np.flatnonzero((h[back:] == h[:-back]) & (line[back:] == line[:-back])) + back
            np.add.at(to, line[same], 1.0)
    signs = (role == 5) | (role == 7) | (role == 6)
    place = np.arange(len(starts)) - np.repeat(np.append(0, line_of_text[:-1]), n_lines)
    own = np.stack(
        [
            np.log1p(size), np.log1p(words), count(~blank) / per_word / 10, count(role == 2) / letters, count(role == 3) / full, 5 * count(role == 4) / full,
            5 * count(role == 5) / full, 5 * count(role == 6) / full, 5 * count(role == 7) / full, count(last & signs) / per_word, again / per_word, twice / per_word,
            (place == 0).astype(float), (size == 0).astype(float),
        ],
        axis=1,
    )
    return own, n_lines, size


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Measures of each line, of the line before and of the line after in its text, and one."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(n_lines)
    before[ends - n_lines] = 0
    after[ends - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1)


def marginals(score: np.ndarray, trans: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected transitions, log of the partition function), documents side by side.

    score: each line's weight for good against bad. Texts are taken by falling length, so at
    step t those still running are the first ones.
    """
    order = np.argsort(-n_lines, kind="stable")
    start, length = (np.cumsum(n_lines) - n_lines)[order], n_lines[order]
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(most), side="left") if most else []
    t = np.exp(trans - trans.max())
    top = trans.max()
    local = np.stack([np.zeros_like(score), score], axis=1)
    shift = local.max(axis=1, keepdims=True)
    emit = np.exp(local - shift)
    alpha, scale = np.zeros_like(emit), np.ones(len(score))
    for k in range(most):
        rows = start[: active[k]] + k
        a = emit[rows] if k == 0 else (alpha[rows - 1] @ t) * emit[rows]
        scale[rows] = a.sum(axis=1)
        alpha[rows] = a / scale[rows, None]
    beta = np.ones_like(emit)
    pair = np.zeros((2, 2))
    for k in range(most - 2, -1, -1):
        rows = start[: active[k + 1]] + k
        onward = emit[rows + 1] * beta[rows + 1]
        pair += np.einsum("ni,ij,nj,n->ij", alpha[rows], t, onward, 1 / scale[rows + 1])
        beta[rows] = (onward @ t.T) / scale[rows + 1, None]
    both = alpha * beta
    log_z = float(np.log(scale).sum() + shift.sum() + top * max(len(score) - len(n_lines), 0))
    return both[:, 1] / both.sum(axis=1), pair, log_z


class Model:
    """Weights of the field: of the standardised features, and of the transitions."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, w: np.ndarray, trans: np.ndarray):
        self.mean, self.spread, self.w, self.trans = mean, spread, w, trans

    def lines(self, own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        x = (with_neighbours(own, n_lines) - self.mean) / self.spread
        return marginals(x @ self.w, self.trans, n_lines)[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Each text's mean marginal, weighted by the bytes of its lines."""
        own, n_lines, size = line_measures(texts)
        good = self.lines(own, n_lines)
        start = np.cumsum(n_lines) - n_lines
        weight = size.astype(float)
        empty = np.add.reduceat(weight, start) == 0
        weight[np.repeat(empty, n_lines)] = 1.0
        return np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)


def fit(own: np.ndarray, n_lines: np.ndarray, labels: np.ndarray) -> Model:
    """Maximum likelihood with decay, by Adam over all training documents at once; labels: one for each document."""
    x = with_neighbours(own, n_lines)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    x = (x - mean) / spread
    y = np.repeat(labels, n_lines).astype(float)
    # both classes weigh the same
    share = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1)) / n_lines
    per_line = np.repeat(share, n_lines)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    theta = np.concatenate([w, trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    steps = np.maximum(n_lines - 1, 0)
    seen = np.array([[((labels == i) * steps).sum() if i == j else 0 for j in range(2)] for i in range(2)], dtype=float)
    for k in range(1, STEPS + 1):
        w, trans = theta[: x.shape[1]], theta[x.shape[1] :].reshape(2, 2)
        good, pair, _ = marginals(x @ w, trans, n_lines)
        slope = np.concatenate([x.T @ (per_line * (good - y)), ((pair - seen) / max(steps.sum(), 1)).ravel()]) + DECAY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta - RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(mean, spread, theta[: x.shape[1]], theta[x.shape[1] :].reshape(2, 2))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in tokens.blocks(texts):
            own, n_lines, _ = line_measures(texts[lo:hi])
            ends = np.cumsum(n_lines)
            keep = [k for k in range(hi - lo) if n_lines[k] <= TRAIN_LINES]
            rows = [own[ends[k] - n_lines[k] : ends[k]].astype("<f4").tobytes() for k in keep]
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(lo, hi - lo).take(pa.array(keep, pa.int64())), pa.array(rows, pa.binary())], names=["quality", "measures"])


def held_out(doc_id):
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, quality), or None without labelled rows."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where("quality in (0, 1)").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    drawn = None
    for q in (0, 1):
        part = own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        drawn = part if drawn is None else drawn.unionByName(part)
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # 2 * train_docs rows at most
    rows = sorted((r[0], bytes(r[1])) for r in wanted.select("quality", "text").mapInArrow(_measured, "quality int, measures binary").collect())
    if len({q for q, _ in rows}) < 2:
        return None
    parts = [np.frombuffer(r, dtype="<f4").reshape(-1, OWN) for _, r in rows]
    return fit(np.concatenate(parts).astype(float), np.array([len(p) for p in parts]), np.array([q for q, _ in rows]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text)."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = np.full(len(texts), 0.5)
            for lo, hi in tokens.blocks(texts):
                if model is not None:
                    scores[lo:hi] = np.clip(model.score(texts[lo:hi]), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
