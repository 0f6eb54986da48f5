"""Vectorised word and shingle hashing over Arrow text batches.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Every kernel
works on the UTF-8 buffer of a whole batch at once, so no per-word Python
object exists on the hot path.  Hashes are 64-bit and deterministic across
processes, so retried tasks produce the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on uint64 (splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def _byte_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(256, dtype=U64) + U64(1 + seed * 1000)) * U64(0x9E3779B97F4A7C15))


_TABLE = _byte_table(0)
_PRIME = 0x9E3779B97F4A7C55  # odd multiplier of the polynomial hashes
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int, base: int = _PRIME) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()[:3]
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    hi = int(offsets[-1]) if len(offsets) else 0
    return raw[lo:hi], offsets - lo


class Words:
    """Words of a batch: ``start``/``end`` byte positions, ``hash``, and
    ``first[d] .. first[d + 1]`` as the word range of document ``d``."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True):
        data, offsets = buffers(texts)
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        word = ~_SEP[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]  # a document start begins a word of its own
        begin[inner] = word[inner]
        stop[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashes:
            self.hash = self._hash(data, word)

    def _hash(self, data: np.ndarray, word: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        length = self.end - self.start
        at = np.flatnonzero(word)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
        with np.errstate(over="ignore"):
            terms = _TABLE[data[at]] * powers(int(length.max()))[inside]
            return mix64(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(U64))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def grams(h: np.ndarray, k: int, base: int = _PRIME) -> np.ndarray:
    """Polynomial hashes of every k consecutive entries (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        # double the covered length, then add the pieces that make up k
        level, size, out, done = h.astype(U64), 1, None, 0
        p = U64(base)
        while True:
            if k & size:
                piece = level[done : done + n]
                out = piece.copy() if out is None else out * _pow(base, size) + piece
                done += size
            if size * 2 > k:
                break
            level = level[: len(level) - size] * _pow(base, size) + level[size:]
            size *= 2
        del p
    return mix64(out)


def _pow(base: int, n: int) -> np.uint64:
    return U64(pow(base, n, 1 << 64))


def starts_of_grams(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over ``n_words - k + 1`` positions: the gram stays in one document."""
    total = int(first[-1])
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))  # end of each word's document
    return np.arange(n) + k <= last[:n]


def minimizers(value: np.ndarray, w: int) -> np.ndarray:
    """For every run of w consecutive values, the index of its smallest one
    (the leftmost of equals); len(value) - w + 1 entries.

    Block prefix/suffix minima: two linear passes whatever w is.
    """
    n = len(value)
    if n < w:
        return np.zeros(0, np.int64)
    if w == 1:
        return np.arange(n)
    pad = (-n) % w
    order = np.concatenate([value, np.full(pad, np.iinfo(np.uint64).max, U64)])
    blocks = order.reshape(-1, w)
    base = np.arange(0, n + pad, w)[:, None]
    pre = np.minimum.accumulate(blocks, axis=1)
    grow = np.ones(blocks.shape, bool)
    grow[:, 1:] = blocks[:, 1:] < pre[:, :-1]
    pre_at = np.maximum.accumulate(np.where(grow, np.arange(w), 0), axis=1) + base
    rev = blocks[:, ::-1]
    suf = np.minimum.accumulate(rev, axis=1)
    grow = np.ones(blocks.shape, bool)
    grow[:, 1:] = rev[:, 1:] <= suf[:, :-1]  # leftmost of equals
    suf_at = (w - 1 - np.maximum.accumulate(np.where(grow, np.arange(w), 0), axis=1))[:, ::-1] + base
    pre_at, suf_at = pre_at.ravel(), suf_at.ravel()
    left, right = suf_at[: n - w + 1], pre_at[w - 1 : n]
    return np.where(order[right] < order[left], right, left)


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20):
    """Parts of a batch with about ``limit`` bytes of text each (one row at least), so that
    working memory does not depend on how many long texts share a batch."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
