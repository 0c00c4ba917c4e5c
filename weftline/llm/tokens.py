"""Tokenising whole texts in executors' Python workers.

The tokenizers file lower-cases a text, cuts it into runs of letters, single digits, runs of
signs and contractions, and gives each piece its ids whatever stands around it. Each worker
keeps the ids of pieces that it has met and asks the library only for new ones. Texts with
other characters than SAFE go to the library one white-space word at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: Pieces that a worker remembers; at the bound it forgets all and starts anew.
CACHE_PIECES = 1_200_000
#: Characters of text encoded in one go, however many texts that is.
BLOCK_CHARS = 1 << 20
#: The id that ends each document.
END_ID = 1

# Characters whose lower case and letter class no Unicode version disputes
# (ASCII and Latin letters below U+0250), and the tokenizer's contractions.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
SAFE = re.compile(f"[\t-\r\x20-\x7e{_LATIN}]*")
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: A text that tells tokenizer files of another normalizer or pre-tokenizer apart.
PROBE = "It's 2024: they'LL pay $1,234.50 (or 90%)!!  Ünï cödé\n\n\tsnake_case a--b x@y.z  'quoted' DON'T ...end "

_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_encoders: dict[str, "PieceEncoder"] = {}


def _classes() -> np.ndarray:
    kind = np.full(256, _SIGN, dtype=np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    kind[ord("a") : ord("z") + 1] = _LETTER
    kind[128:] = _LETTER  # in texts of SAFE characters
    kind[ord("0") : ord("9") + 1] = _DIGIT
    return kind


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "PieceEncoder":
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        found = PieceEncoder(path)
        ids, _ = found.encode([PROBE], None)
        if ids.tolist() != found.tokenizer.encode(PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path} cuts texts in another way than this encoder")
        _encoders[path] = found
    return _encoders[path]


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for 256 and on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


class PieceEncoder:
    """ids of whole texts, equal to the library's encode(text, add_special_tokens=False).

    Pieces are found, hashed to 64 bits and looked up as numpy arrays; the library's model is
    asked once for each piece that this worker hasn't met.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cache_pieces = cache_pieces
        self.kind = _classes()
        rng = np.random.default_rng(7)
        self.mix = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.powers = np.ones(1, dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.bits = 16
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)  # 0: free
        self.slot = np.zeros(1 << self.bits, dtype=np.int32)
        self.known = 0
        self.lengths = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.flat = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0
        self.words: dict[bytes, list[int]] = {}

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is or would go in the open-addressed table."""
        mask = np.uint64(len(self.keys) - 1)
        at = (h >> np.uint64(20)) & mask
        left = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & mask
            k = self.keys[at[left]]
            left = left[(k != h[left]) & (k != 0)]
        return at

    def _put(self, h: np.ndarray, slot: np.ndarray) -> None:
        while len(h):
            at = self._find(h)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.slot[at[first]] = h[first], slot[first]
            rest = np.ones(len(h), dtype=bool)
            rest[first] = False
            h, slot = h[rest], slot[rest]

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        ids = []
        for p in pieces:
            text = p.decode() if p.isascii() else p.decode("latin1").translate(self.letters)
            ids.append([t.id for t in self.model.tokenize(text)])
        n, m = self.known, len(pieces)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=m)
        total = int(sizes.sum())
        while n + m > len(self.lengths):
            self.lengths, self.starts = np.concatenate([self.lengths] * 2), np.concatenate([self.starts] * 2)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        self.flat[self.used : self.used + total] = [i for x in ids for i in x]
        self.lengths[n : n + m] = sizes
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.known += m
        if self.known * 2 > len(self.keys):
            old = self.keys != 0
            k, s = self.keys[old], self.slot[old]
            while self.known * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.slot = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
            self._put(k, s)
        self._put(h, np.arange(n, n + m, dtype=np.int32))

    def _pieces(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of lower-case text bytes that end in white space."""
        kind = self.kind[b]
        start = np.ones(len(b), dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        for q in np.flatnonzero(b == 39):
            if q == 0 or kind[q - 1] != _SIGN:
                tail = b[q : q + 3].tobytes().decode("latin1")
                for c in CONTRACTIONS:
                    if tail.startswith(c):
                        start[q + 1 : q + len(c)] = False
                        start[q + len(c)] = True
                        break
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(b))
        real = kind[at] != _SPACE
        return at[real], end[real]

    def _safe(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and, for each text, where its ids end."""
        parts = [t.lower().encode() + b"\n" for t in texts]
        b = np.frombuffer(b"".join(parts), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        start, end = self._pieces(b)
        if not len(start):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        n = end - start
        while len(self.powers) < n.max():
            more = self.powers * self.base ** np.uint64(len(self.powers))
            self.powers = np.concatenate([self.powers, more])
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        value = self.mix[b[inside + np.repeat(start, n)]] * self.powers[inside]
        h = np.add.reduceat(value, first)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h |= np.uint64(1)
        at = self._find(h)
        new = np.flatnonzero(self.keys[at] == 0)
        if len(new):
            hashes, k = np.unique(h[new], return_index=True)
            raw = b.tobytes()
            self._learn(hashes, [raw[start[i] : end[i]] for i in new[k]])
            at = self._find(h)
        slot = self.slot[at]
        lengths = self.lengths[slot].astype(np.int64)
        stop = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[slot] - (stop - lengths), lengths) + np.arange(int(stop[-1]))]
        return ids, np.concatenate([[0], stop])[np.searchsorted(start, ends)]

    def _word(self, word: bytes) -> list[int]:
        if word not in self.words:
            if len(self.words) >= self.cache_pieces // 8:
                self.words.clear()
            self.words[word] = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return self.words[word]

    def encode(self, texts: list[str | None], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): text k has ids[offsets[k]:offsets[k + 1]]; null counts as empty."""
        if self.known > self.cache_pieces:
            self._forget()
        safe = [bool(t is not None and "<|" not in t and SAFE.fullmatch(t)) for t in texts]
        ids, ends = self._safe([t if ok else "" for t, ok in zip(texts, safe, strict=True)])
        if not all(safe[k] or texts[k] is None for k in range(len(texts))):
            parts, at = [], 0
            for k, t in enumerate(texts):
                parts.append(ids[at : ends[k]] if safe[k] or t is None else np.array([i for w in t.encode().split() for i in self._word(w)], dtype=np.uint32))
                at = ends[k]
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        if end_id is None:
            return ids, offsets
        return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(texts) + 1)


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters at most, or one text."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > at and size + n > limit:
            yield at, k
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
