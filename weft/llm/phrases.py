"""Substring dedup by repeated-phrase automata.

Passages of ``WINDOW`` words that an earlier document (smaller key) has are
removed from later ones.

Recurring passages are confirmed shard by shard: a shard is the set of all runs
of windows with certain anchors (see ``repeats``), read from every document that
holds one.  Each shard compiles one Aho-Corasick automaton (pyahocorasick) of its
recurring phrases: whole runs that several documents share, and 13-word windows
that runs with different surroundings share.  A word is one character of the
automaton's alphabet, so a phrase matches whole words only.  All runs of all
documents that reach the shard stream through its automaton, which locates every
occurrence together with the smallest key that has the phrase.

Defined cases: null and empty texts have no words; texts shorter than a window
lose nothing; a null key counts as larger than any other; rows that share a key
do not remove each other's words; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.repeats import LAST, Prefix, buckets_for, candidates, covered, each, order_of, recurring, runs, spans_of, with_row_id, with_windows
from weft.llm.stages import forget
from weft.llm.tokens import Words, grams, minimizers, mix64, slices, starts_of_grams

WINDOW, GRAM = 13, 6


def _anchors(window: int, gram: int):
    def anchors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = Words(texts)
        g = grams(w.hash, gram)
        first, n, at = runs(minimizers(g, window - gram + 1), starts_of_grams(w.first, window))
        doc = w.doc_of_word()[first] if len(first) else first
        return doc, first - w.first[doc], n, g[at] if len(at) else np.zeros(0, np.uint64)

    return anchors


class _Text:
    def __init__(self, texts: pa.Array, window: int):
        self.w, self.window = Words(texts), window
        length = self.w.end - self.w.start
        self.at = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.full(int(self.at[-1]), 32, np.uint8)
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(self.at[:-1], length) + inside] = self.w.data[np.repeat(self.w.start, length) + inside]
        self.compact = out  # words, one space after each
        self.length = length

    def units(self, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        lo = self.w.first[doc] + start
        hi = lo + n + self.window - 1
        raw = self.compact.tobytes()
        return Prefix(self.w.hash).of(lo, hi), [raw[a : b - 1] for a, b in zip(self.at[lo].tolist(), self.at[hi].tolist())]

    def windows(self, doc: np.ndarray, start: np.ndarray, n: np.ndarray):
        run, window = each(start, n)
        at = self.w.first[doc][run] + window
        gram = max(1, 3 * self.window // 4)
        with np.errstate(over="ignore"):
            g = grams(mix64(self.w.hash + np.uint64(0x5851F42D4C957F2D)), gram, 0xDA942042E4DD58B5)
        return run, window, grams(self.w.hash, self.window)[at], g[minimizers(g, self.window - gram + 1)[at]], at

    def content(self, first: int, last: int) -> bytes:
        return self.compact[self.at[first] : self.at[last + self.window] - 1].tobytes()


def _letters(codes: np.ndarray) -> str:
    """One character a code, none of them a surrogate."""
    c = codes.astype(np.uint32) + 1
    c[c >= 0xD800] += 0x800
    return c.astype("<u4").tobytes().decode("utf-32-le")


def _resolve(window: int):
    def resolve(key: np.ndarray, content: list[bytes], order: np.ndarray, flag: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids: dict[bytes, int] = {}
        unit = np.array([ids.setdefault(c, len(ids)) for c in content])
        least = np.full(len(ids), LAST)
        np.minimum.at(least, unit, order)
        most = np.full(len(ids), -LAST)
        np.maximum.at(most, unit, order)
        words = Words(pa.array(list(ids), pa.binary()))
        _, codes = np.unique(words.hash, return_inverse=True)
        text = _letters(codes)
        bounds = words.first.tolist()
        # confirm: runs that several keys share, and windows that different runs share
        phrases: dict[str, int] = {}
        for u in np.flatnonzero(least < most).tolist():
            phrases[text[bounds[u] : bounds[u + 1]]] = int(least[u])
        inside = np.flatnonzero(starts_of_grams(words.first, window))
        h = grams(words.hash, window)[inside]
        owner = words.doc_of_word()[inside]
        by = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]]) if len(by) else by
        lo, hi = np.minimum.reduceat(owner[by], head), np.maximum.reduceat(owner[by], head)
        first, last = np.minimum.reduceat(least[owner[by]], head), np.maximum.reduceat(most[owner[by]], head)
        for j in np.flatnonzero((lo < hi) & (first < last)).tolist():
            at = int(inside[by[head[j]]])
            phrase = text[at : at + window]
            phrases[phrase] = min(int(first[j]), phrases.get(phrase, LAST))
        nothing = np.zeros(0, np.int64)
        if not phrases:
            return nothing, nothing, nothing
        automaton = ahocorasick.Automaton()
        for phrase, who in phrases.items():
            automaton.add_word(phrase, (len(phrase), who))
        automaton.make_automaton()
        # stream every run through the automaton; a match of a phrase holds len - window + 1 windows
        windows = np.diff(words.first) - window + 1
        base = np.cumsum(windows) - windows
        earliest = np.full(int(windows.sum()), LAST)
        for u, offset in enumerate(base.tolist()):
            a = bounds[u]
            for end, (size, who) in automaton.iter(text[a : bounds[u + 1]]):
                s = offset + end + 1 - size
                if size == window:
                    if who < earliest[s]:
                        earliest[s] = who
                else:
                    part = earliest[s : s + size - window + 1]
                    np.minimum(part, who, out=part)
        row, place = each(base[unit], windows[unit])
        go = earliest[place] < order[row]
        return row[go], (place - base[unit][row])[go], np.ones(int(go.sum()), np.int64)

    return resolve


def repeated_windows(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with rid, runs of windows that an earlier document has)."""
    rows = with_row_id(docs, "_rid", key, text).select(F.col(key).alias("key"), F.col("_rid").alias("rid"), order_of(key).alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = buckets_for(docs, text)
    gram = max(1, min(GRAM, (window + 1) // 2))
    found, hot = candidates(rows, _anchors(window, gram), True, buckets, "phrases")
    gone = recurring(rows, found, hot > 0, lambda texts: _Text(texts, window), _resolve(window), True, buckets, "phrases")
    forget(found)
    return rows, gone


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept): ``kept`` is what is left of each text, words joined by one space."""
    rows, gone = repeated_windows(docs, window, key, text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            t = _Text(b.column(1), window)
            first = t.w.first.tolist()
            removed, kept = [], []
            for d, spans in enumerate(spans_of(b.column(2))):
                lo, hi = first[d], first[d + 1]
                body = t.compact[t.at[lo] : t.at[hi]]
                mask = np.zeros(hi - lo, bool) if spans is None else covered(*spans, window, hi - lo)
                removed.append(int(mask.sum()))
                if removed[-1]:
                    body = body[np.repeat(~mask, t.length[lo:hi] + 1)]
                kept.append(body[:-1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(t.w.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[key, "n_words", "n_removed", "kept"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return with_windows(rows, gone).select("key", "text", "gone").mapInArrow(apply, f"`{key}` {kind}, n_words long, n_removed long, kept string")

