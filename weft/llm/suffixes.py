"""Suffix-array dedup by depth-limited radix sort.

Suffixes are ordered only through their first ``DEPTH`` bytes, by passes over
digits, most significant first; after the last pass, suffixes in one group are
exactly the repeated windows.  The first digit is the suffix's anchor (see
``repeats``): suffixes whose anchor occurs once are alone in their group and are
dropped at once, and a run of suffixes with one anchor travels as one row.  In the
reducer, equal runs are a group as a whole; the suffixes of runs that differ are
put in order by passes over digits of eight bytes, and a pass keeps only groups of two
and more.

Every byte covered by a repeated window goes, in all its places.

Defined cases: null texts count as empty; texts shorter than the depth lose
nothing; matches never cross documents; repeated rows are places of their own, so both lose their windows; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.repeats import Prefix, buckets_for, candidates, covered, each, order_of, recurring, runs, spans_of, with_row_id, with_windows
from weft.llm.stages import forget
from weft.llm.tokens import _byte_table, buffers, grams, minimizers, slices

DEPTH = 400
DIGIT = 8  # bytes
_BYTES, _OTHER = _byte_table(3), _byte_table(4)


def _inside(offsets: np.ndarray, depth: int) -> np.ndarray:
    total = int(offsets[-1])
    n = total - depth + 1
    if n <= 0:
        return np.zeros(0, bool)
    return np.arange(n) + depth <= np.repeat(offsets[1:], np.diff(offsets))[:n]


def _anchors(depth: int):
    gram = max(1, depth // 4)

    def anchors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = buffers(texts)
        g = grams(_BYTES[data], gram)
        first, n, at = runs(minimizers(g, depth - gram + 1), _inside(offsets, depth))
        doc = np.searchsorted(offsets, first, side="right") - 1
        return doc, first - offsets[doc], n, g[at] if len(at) else np.zeros(0, np.uint64)

    return anchors


class _Text:
    def __init__(self, texts: pa.Array, depth: int):
        (self.data, self.offsets), self.depth = buffers(texts), depth

    def units(self, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        lo = self.offsets[doc] + start
        hi = lo + n + self.depth - 1
        raw = self.data.tobytes()
        return Prefix(_BYTES[self.data]).of(lo, hi), [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())]

    def windows(self, doc: np.ndarray, start: np.ndarray, n: np.ndarray):
        run, window = each(start, n)
        at = self.offsets[doc][run] + window
        gram = max(1, 3 * self.depth // 4)
        g = grams(_OTHER[self.data], gram, 0xDA942042E4DD58B5)
        return run, window, grams(_BYTES[self.data], self.depth)[at], g[minimizers(g, self.depth - gram + 1)[at]], at

    def content(self, first: int, last: int) -> bytes:
        return self.data[first : last + self.depth].tobytes()


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number (zeros beyond the end)."""
    wide = np.zeros(len(data) + DIGIT - 1, np.uint64)
    wide[: len(data)] = data
    for shift in (1, 2, 4):
        rest = np.zeros(len(wide), np.uint64)
        rest[:-shift] = wide[shift:]
        wide = (wide << np.uint64(8 * shift)) | rest
    return wide[: len(data)]


def radix_groups(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Indices into ``at``, in order of their suffixes, of those whose first ``depth`` bytes another suffix shares.

    A digit is the next eight bytes (the last one takes what is left).  A pass orders the
    members of the groups that hold several digits, and drops whoever is left alone.
    """
    digits = _words(data)
    alive, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for done in range(0, depth, DIGIT):
        if not len(alive):
            break
        digit = digits[at[alive] + done]
        if depth - done < DIGIT:
            digit = digit >> np.uint64(8 * (DIGIT - depth + done))
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.append(head, len(group)))
        split = np.repeat(np.logical_or.reduceat(digit != np.repeat(digit[head], size), head), size)
        some = np.flatnonzero(split)
        if len(some):
            order = some[np.lexsort((digit[some], group[some]))]
            alive[some], digit[some] = alive[order], digit[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(group)))
        keep = np.repeat(size > 1, size)
        alive, group = alive[keep], np.repeat(np.arange(len(first)), size)[keep]
    return alive


def _resolve(depth: int):
    def resolve(key: np.ndarray, content: list[bytes], order: np.ndarray, flag: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids: dict[bytes, int] = {}
        unit = np.array([ids.setdefault(c, len(ids)) for c in content])
        whole = (np.bincount(unit, minlength=len(ids)) > 1) | (np.bincount(unit, flag, len(ids)) > 0)
        raw = b"".join(ids)
        data = np.frombuffer(raw, np.uint8)
        size = np.array([len(c) for c in ids], np.int64)
        begin = np.cumsum(size) - size
        windows = size - depth + 1
        base = np.cumsum(windows) - windows
        _, at = each(begin, windows)
        twice = np.zeros(len(at), bool)
        twice[radix_groups(data, at, depth)] = True
        twice |= np.repeat(whole, windows)
        row, place = each(base[unit], windows[unit])
        go = twice[place]
        return row[go], (place - base[unit][row])[go], np.ones(int(go.sum()), np.int64)

    return resolve


def repeated_windows(docs: DataFrame, depth: int = DEPTH, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with rid, runs of windows that occur twice or more)."""
    rows = with_row_id(docs, "_rid", key, text).select(F.col(key).alias("key"), F.col("_rid").alias("rid"), order_of(key).alias("ord"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    buckets = buckets_for(docs, text)
    found, hot = candidates(rows, _anchors(depth), False, buckets, "suffixes")
    gone = recurring(rows, found, hot > 0, lambda texts: _Text(texts, depth), _resolve(depth), False, buckets, "suffixes")
    forget(found)
    return rows, gone


def remove_repeats(docs: DataFrame, depth: int = DEPTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): ``kept`` is what is left of each text, as bytes."""
    rows, gone = repeated_windows(docs, depth, key, text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            data, offsets = buffers(b.column(1))
            removed, spans_of_doc, kept = [], [], []
            for d, spans in enumerate(spans_of(b.column(2))):
                body = data[offsets[d] : offsets[d + 1]]
                if spans is None:
                    removed.append(0)
                    spans_of_doc.append(0)
                else:
                    mask = covered(*spans, depth, len(body))
                    removed.append(int(mask.sum()))
                    spans_of_doc.append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()))
                    body = body[~mask]
                kept.append(body.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_of_doc, pa.int64()), pa.array(kept, pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return with_windows(rows, gone).select("key", "text", "gone").mapInArrow(apply, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
