"""Benchmark decontamination by pigeonhole edit matching.

An item leaks into a text if the text holds a passage within the item's error
budget (``RATE`` of its length, in characters of normalised text).  The item is
split into budget + 1 pieces: a passage with at most budget edits leaves one piece
untouched, so every leak shows an exact piece.  An Aho-Corasick automaton of all
pieces runs over each whole text; every (item, diagonal) with a hit is verified
by Myers' bit-parallel distance on Python integers of any width.

Benchmark items reach the workers in chunks of at most ``CHUNK_BYTES``, one pass
over the texts a chunk, so what a task holds is bounded whatever the benchmark's
size; the chunk's size is checked, not assumed.

Normalised text: lower case, words of letters, digits and ``_`` joined by one
space, with a space at both ends, so a match keeps to word borders up to edits.

Defined cases: null or empty texts hold no leak; null items and items without
words match nothing; equal items are reported one by one; repeated rows are
reported once a (key, item) pair with the smallest distance; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.stages import stage
from weft.llm.tokens import slices

RATE = 0.08
CHUNK_BYTES = 8 << 20
_WORD = re.compile(r"\w+")


def normalised(text: str | None) -> str:
    words = _WORD.findall(text.lower()) if text else []
    return f" {' '.join(words)} " if words else ""


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of near equal length that cover the item."""
    n, size = errors + 1, len(item)
    cuts = [size * j // n for j in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Myers:
    """Smallest edit distance of a pattern to any substring of a text."""

    def __init__(self, pattern: str):
        self.n = len(pattern)
        self.mask = (1 << self.n) - 1
        self.high = 1 << (self.n - 1)
        self.eq: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.eq[c] |= 1 << i

    def best(self, text: str, at_most: int) -> int:
        """The distance, or at_most + 1 if it is larger."""
        pv, mv, score, least = self.mask, 0, self.n, self.n
        mask, high, eq_of = self.mask, self.high, self.eq
        left = len(text)
        for c in text:
            eq = eq_of.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = (mv | ~(xh | pv)) & mask
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < least:
                    least = score
                    if not least:
                        return 0
            left -= 1
            if score - left > at_most and least > at_most:
                break
            ph = (ph << 1) & mask  # a passage may start anywhere
            mh = (mh << 1) & mask
            pv = (mh | ~(xv | ph)) & mask
            mv = ph & xv
        return min(least, at_most + 1)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(key, text, budget(text, rate)) for key, text in ((k, normalised(t)) for k, t in items) if text]
        self.myers: dict[int, Myers] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                places[piece].append((i, offset))
        self.automaton = None
        if places:
            self.automaton = ahocorasick.Automaton()
            for piece, where in places.items():
                self.automaton.add_word(piece, (len(piece), where))
            self.automaton.make_automaton()

    def leaks(self, text: str) -> dict[int, int]:
        """index of item -> smallest distance, for items within their budget."""
        found: dict[int, int] = {}
        if self.automaton is None or not text:
            return found
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(text):
            for i, offset in where:
                start = end + 1 - size - offset  # where the item would begin without edits before the piece
                spans[i].append((start - self.items[i][2], start + len(self.items[i][1]) + self.items[i][2]))
        for i, windows in spans.items():
            _, item, errors = self.items[i]
            windows.sort()
            lo, hi = windows[0]
            merged = []
            for a, b in windows[1:]:
                if a > hi:
                    merged.append((lo, hi))
                    lo, hi = a, b
                else:
                    hi = max(hi, b)
            merged.append((lo, hi))
            if i not in self.myers:
                self.myers[i] = Myers(item)
            best = errors + 1
            for lo, hi in merged:
                part = text[max(0, lo) : max(0, hi)]
                best = 0 if item in part else min(best, self.myers[i].best(part, errors))
                if not best:
                    break
            if best <= errors:
                found[i] = best
        return found


def chunks(benchmark: DataFrame, item_key: str, text: str, limit: int = CHUNK_BYTES) -> Iterator[list[tuple[int, str]]]:
    part: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(item_key, text).where(F.col(text).isNotNull()).toLocalIterator():
        part.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item key, distance): every item that a text holds within the item's error budget."""
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, distance int"
    out, done = None, []
    for part in chunks(benchmark, item_key, text):

        def scan(batches: Iterator[pa.RecordBatch], part: list = part) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(part, rate)
            for b in (s for whole in batches for s in slices(whole, 1)):
                ids, items, distances = [], [], []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for i, d in matcher.leaks(normalised(t)).items():
                        ids.append(k)
                        items.append(matcher.items[i][0])
                        distances.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(items, pa.array([p[0] for p in part]).type), pa.array(distances, pa.int32())], names=[key, item_key, "distance"])

        if out is not None:  # a written table lets go of its chunk: the driver holds one at a time
            done.append(stage(out, "leaks"))
        out = docs.select(key, text).mapInArrow(scan, schema)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    for before in done:
        out = out.unionByName(before)
    return out.groupBy(key, item_key).agg(F.min("distance").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The documents that hold no item; each row is kept or left by its own text, whatever its key.

    A chunk of the benchmark is a pass; what is left after it is written before the next one.
    """
    at = docs.columns.index(text)
    out = None
    for part in chunks(benchmark, item_key, text):

        def clean(batches: Iterator[pa.RecordBatch], part: list = part) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(part, rate)
            for b in (s for whole in batches for s in slices(whole, at)):
                yield b.filter(pa.array([not matcher.leaks(normalised(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        before = docs if out is None else stage(out, "decontaminated")
        out = before.mapInArrow(clean, docs.schema)
    return docs if out is None else out
