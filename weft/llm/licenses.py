"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Texts become lower-case words; features are five-word shingles (three-word ones
for templates of three or four words).  Templates are
indexed in pieces of at most ``PIECE`` words.  Every whole text is cut into
overlapping windows of three sizes, so that each piece lies inside a window of its
class: 5 words every 2 for pieces of 3 or 4 words, 8 every 2 for up to 7, 16 every
5 for longer ones.  One MinHash value is one band; with J the Jaccard similarity of a piece
and the window around it, all ``BANDS`` bands miss it with probability
(1 - J)**BANDS.  J is at least 1/4 for pieces of five words and 1/3
for others, so the miss probability is below 1.1e-6 for a piece; a longer template
has several pieces.  Retrieved templates are verified exactly: the share of the
template's shingles, as words, that stand in the text around the window.

Templates are a parameter; they go to the workers in parts of ``MAX_TEMPLATES`` bytes
at most, each in a scan of its own.

Defined cases: null and empty texts, and texts shorter than a shingle, match
nothing; templates under three words are refused; a license found in several places of a
text is one row with its best containment and, of equals, its first place;
repeated rows are reported once a (key, license); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.tokens import Words, buffers, grams, slices, starts_of_grams

SHINGLE, PIECE, BANDS = 5, 12, 48
CONTAINMENT = 0.8
MAX_TEMPLATES = 4 << 20
#: (words a window, words from one window to the next, least and most words of its pieces, words a shingle)
CLASSES = ((5, 2, 3, 4, 3), (8, 2, 5, 7, 5), (16, 5, 8, 12, 5))

# Public license notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_NOT_WORD = np.ones(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _NOT_WORD[list(_r)] = False
_WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text or "")]


def _blank(texts: pa.Array) -> pa.Array:
    """The texts' bytes with every byte that belongs to no word replaced by a space."""
    data, offsets = buffers(texts)
    out = data.copy()
    out[_NOT_WORD[data]] = 32
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


class Index:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT):
        self.containment = containment
        if sum(len(t.encode()) for _, t in templates) > MAX_TEMPLATES:
            raise ValueError(f"templates exceed {MAX_TEMPLATES} bytes: scan them in several calls")
        self.templates = [(name, words_of(text)) for name, text in templates]
        if any(len(w) < 3 for _, w in self.templates):
            raise ValueError("a template needs three words at least")
        self.size = [SHINGLE if len(w) >= SHINGLE else 3 for _, w in self.templates]
        self.shingles = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for (_, w), k in zip(self.templates, self.size)]
        rng = np.random.default_rng(5)
        self.multiply = rng.integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, BANDS, dtype=np.uint64)
        #: per class and band: sorted values, the templates they stand for, and a bitmap of their first 16 bits
        self.bands = []
        for _, _, least, most, shingle in CLASSES:
            entries: list[list[tuple[int, int]]] = [[] for _ in range(BANDS)]
            for t, (_, w) in enumerate(self.templates):
                cuts = [w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - SHINGLE, PIECE // 2)]
                for piece in cuts:
                    if least <= len(piece) <= most:
                        h = grams(self._words(pa.array([" ".join(piece)])).hash, shingle)
                        for band in range(BANDS):
                            entries[band].append((int(self._permute(h, band).min()), t))
            table = []
            for e in entries:
                e.sort()
                values = np.array([v for v, _ in e], np.uint64)
                bitmap = np.zeros(1 << 16, bool)
                bitmap[(values >> np.uint64(48)).astype(np.int64)] = True
                table.append((values, np.array([t for _, t in e], np.int64), bitmap))
            self.bands.append(table)

    @staticmethod
    def _words(texts: pa.Array) -> Words:
        return Words(_blank(texts), lower=True)

    def _permute(self, h: np.ndarray, band: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = h * self.multiply[band] + self.add[band]
            return x ^ (x >> np.uint64(31))

    def retrieve(self, texts: pa.Array) -> tuple[list[tuple[int, int, int]], Words]:
        """(document, first word of the window, template) of every band hit."""
        w = self._words(texts)
        hits: set[tuple[int, int, int]] = set()
        doc = w.doc_of_word()
        top = np.iinfo(np.uint64).max
        for shingle in sorted({c[4] for c in CLASSES}):
            h = grams(w.hash, shingle)
            if not len(h):
                continue
            inside = starts_of_grams(w.first, shingle)
            plans = []
            for (size, step, _, _, own), bands in zip(CLASSES, self.bands):
                if own == shingle and len(bands[0][0]):
                    # windows start every ``step`` words of their own document, so what other texts share a batch is no matter
                    at = np.flatnonzero(((np.arange(len(h)) - w.first[doc[: len(h)]]) % step == 0) & inside)
                    plans.append((size - shingle + 1, at, bands, w.first[doc[at] + 1] - shingle))
            for band in range(BANDS):
                x = self._permute(h, band)
                x[~inside] = top
                for per, at, bands, last in plans:
                    values, owner, bitmap = bands[band]
                    low = x[at]
                    for j in range(1, per):
                        np.minimum(low, np.where(at + j <= last, x[np.minimum(at + j, len(x) - 1)], top), out=low)
                    maybe = np.flatnonzero(bitmap[(low >> np.uint64(48)).astype(np.int64)])
                    if len(maybe):
                        lo, hi = np.searchsorted(values, low[maybe], "left"), np.searchsorted(values, low[maybe], "right")
                        for m, a, b in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo]):
                            hits.update((int(doc[at[m]]), int(at[m]), int(t)) for t in owner[a:b])
        return sorted(hits), w

    def scan(self, texts: pa.Array) -> dict[tuple[int, str], tuple[float, int]]:
        """(document, license) -> (containment, first word), verified."""
        hits, w = self.retrieve(texts)
        found: dict[tuple[int, str], tuple[float, int]] = {}
        for d, at, t in hits:
            name, template = self.templates[t]
            lo = max(int(w.first[d]), at - len(template) - PIECE)
            hi = min(int(w.first[d + 1]), at + 2 * len(template) + PIECE + SHINGLE)
            around = [w.word_bytes(i).decode("utf-8", "replace").lower() for i in range(lo, hi)]
            here = [tuple(around[i : i + self.size[t]]) for i in range(len(around) - self.size[t] + 1)]
            wanted = self.shingles[t]
            shared = wanted & set(here)
            share = len(shared) / len(wanted)
            if share >= self.containment:
                place = lo - int(w.first[d]) + min(i for i, s in enumerate(here) if s in shared)
                old = found.get((d, name))
                if old is None or (share, -place) > (old[0], -old[1]):
                    found[(d, name)] = (share, place)
        return found


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, containment, first_word): every license notice that a text holds; a pass over the texts for each ``MAX_TEMPLATES`` bytes of templates."""
    parts: list[list[tuple[str, str]]] = [[]]
    for name, notice in templates:
        if parts[-1] and sum(len(t.encode()) for _, t in [*parts[-1], (name, notice)]) > MAX_TEMPLATES:
            parts.append([])
        parts[-1].append((name, notice))
    rows = None
    for part in parts:
        found = _scan(docs, Index(tuple(part), containment), key, text)
        rows = found if rows is None else rows.unionByName(found)
    return rows.groupBy(key, "license").agg(F.max("containment").alias("containment"), F.expr("min_by(first_word, struct(-containment, first_word))").alias("first_word"))


def _scan(docs: DataFrame, index: Index, key: str, text: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            found = index.scan(b.column(1))
            ids = b.column(0).to_pylist() if found else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d, _ in found], b.column(0).type), pa.array([n for _, n in found], pa.string()), pa.array([s for s, _ in found.values()], pa.float64()), pa.array([p for _, p in found.values()], pa.int64())],
                names=[key, "license", "containment", "first_word"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(scan, f"`{key}` {kind}, license string, containment double, first_word long")
