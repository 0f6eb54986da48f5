"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one vectorised pass over whole texts.  The trees are
trained on the driver from a bounded, documented sample of labelled rows
(``SAMPLE``), flattened into arrays of (feature, threshold, children, value),
and applied by numpy traversal of all rows of a batch at once.  Labels, lang,
source and ids are never inputs.

Defined cases: null and empty texts have all statistics 0 and still get a
score; labels that are null or refer to no document are left out; with labels of
one class only, or none, every score is that class's share (0.5 for none); equal
rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.stages import stage
from weft.llm.tokens import Words, slices

SAMPLE = 20_000  # labelled rows that the model is fitted on, at most
ROUNDS, DEPTH, RATE, BINS, LAMBDA, MIN_CHILD = 80, 4, 0.15, 48, 1.0, 8.0

_KINDS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 space, 7 newline, 8 beyond ASCII
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 1, 2, 3
for _c in b".,;:?'\"-()":
    _KINDS[_c] = 4
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _KINDS[_c] = 5
_KINDS[[9, 11, 12, 13, 32]] = 6
_KINDS[10] = 7
_KINDS[128:] = 8

FEATURES = (
    "log_bytes", "log_words", "mean_word", "lower", "upper", "digit", "mark", "symbol", "space", "newline", "high", "caps_words", "symbol_words",
    "one_char_words", "long_words", "distinct_words", "adjacent_repeats", "top_word", "distinct_pairs", "distinct_lines", "mean_line", "mark_words",
)


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[first[1:]] - total[first[:-1]]).astype(float)


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest one, per document."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(d)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], count)
    return np.bincount(d[at], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """(documents, features) of a batch."""
    w = Words(texts)
    n, f = len(w.offsets) - 1, w.first
    size = np.diff(w.offsets).astype(float)
    kind = _KINDS[w.data]
    share = [_per_doc(kind == k, w.offsets) / np.maximum(size, 1) for k in (1, 2, 3, 4, 5, 6, 7, 8)]
    words = np.diff(f).astype(float)
    per = np.maximum(words, 1)
    length = w.end - w.start
    total = [np.concatenate([[0], np.cumsum(kind == k)]) for k in (2, 4, 5)]
    upper, mark, symbol = (t[w.end] - t[w.start] if len(w.start) else np.zeros(0) for t in total)
    doc = w.doc_of_word()
    distinct, top = _distinct(doc, w.hash, n)
    near = np.zeros(len(doc), bool)
    near[1:] = (doc[1:] == doc[:-1]) & (w.hash[1:] == w.hash[:-1])
    with np.errstate(over="ignore"):
        pair = w.hash[:-1] * np.uint64(3) + w.hash[1:] if len(doc) else w.hash
    same = doc[1:] == doc[:-1]
    pairs, _ = _distinct(doc[1:][same], pair[same] if len(doc) else pair, n)
    # a line is the words between newlines: sum their position-dependent hashes
    newline = np.concatenate([[0], np.cumsum(kind == 7)])
    line = newline[w.start] if len(w.start) else np.zeros(0, np.int64)
    head = np.ones(len(doc), bool)
    head[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    with np.errstate(over="ignore"):
        value = np.add.reduceat(w.hash * (np.arange(len(doc)) - np.repeat(at, np.diff(np.append(at, len(doc)))) + 1).astype(np.uint64), at) if len(at) else w.hash
    lines = np.bincount(doc[at], minlength=n).astype(float) if len(at) else np.zeros(n)
    different, _ = _distinct(doc[at], value, n) if len(at) else (np.zeros(n), None)
    out = [np.log1p(size), np.log1p(words), _per_doc(length, f) / per, *share]
    out += [_per_doc((upper >= 2) & (upper * 2 > length), f) / per, _per_doc(symbol > 0, f) / per, _per_doc(length == 1, f) / per, _per_doc(length > 14, f) / per]
    out += [distinct / per, _per_doc(near, f) / per, top / per, pairs / np.maximum(words - 1, 1), different / np.maximum(lines, 1), words / np.maximum(lines, 1), _per_doc(mark > 0, f) / per]
    return np.stack(out, axis=1)


class Trees:
    """Boosted trees as flat arrays; node 0 of each tree is its root, leaves point to themselves."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, depth: int):
        self.base, self.feature, self.threshold, self.left, self.right, self.value, self.depth = base, feature, threshold, left, right, value, depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            out += value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Newton boosting of the logistic loss over quantile histograms."""
    nodes = 2 ** (depth + 1) - 1
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        flat = np.zeros((0, nodes))
        return Trees(base, flat.astype(int), flat, flat.astype(int), flat.astype(int), flat, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, value = np.zeros(nodes, int), np.full(nodes, np.inf), np.zeros(nodes)
        left, right = np.arange(nodes), np.arange(nodes)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, count = 2**level - 1, 2**level
            here = np.flatnonzero(node >= lo)
            if not len(here):
                break
            local = node[here] - lo
            gain, choice = np.zeros(count), [None] * count
            total_g = np.bincount(local, g[here], count)
            total_h = np.bincount(local, h[here], count)
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                cell = local * (BINS + 1) + binned[here, j]
                hist_g = np.bincount(cell, g[here], count * (BINS + 1)).reshape(count, -1).cumsum(1)[:, : len(cut)]
                hist_h = np.bincount(cell, h[here], count * (BINS + 1)).reshape(count, -1).cumsum(1)[:, : len(cut)]
                rest_g, rest_h = total_g[:, None] - hist_g, total_h[:, None] - hist_h
                better = hist_g**2 / (hist_h + LAMBDA) + rest_g**2 / (rest_h + LAMBDA) - (total_g**2 / (total_h + LAMBDA))[:, None]
                better[(hist_h < MIN_CHILD / 8) | (rest_h < MIN_CHILD / 8)] = 0
                best = better.argmax(1)
                for k in range(count):
                    if better[k, best[k]] > gain[k] + 1e-9:
                        gain[k], choice[k] = better[k, best[k]], (j, int(best[k]))
            for k in range(count):
                at = lo + k
                if choice[k] is None or gain[k] < 1e-3:
                    continue
                j, b = choice[k]
                feature[at], threshold[at], left[at], right[at] = j, cuts[j][b], 2 * at + 1, 2 * at + 2
                mine = here[local == k]
                node[mine] = np.where(binned[mine, j] <= b, 2 * at + 1, 2 * at + 2)
        used = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
        value = RATE * used[0] / (used[1] + LAMBDA)
        margin += value[node]
        trees.append((feature, threshold, left, right, value))
    return Trees(base, *(np.stack(part) for part in zip(*trees)), depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int = SAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y) of at most ``limit`` labelled rows, picked by a hash of the key.

    The sample's ids are joined in first; their number is bounded by ``limit``,
    so that side may be broadcast.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & allowed).groupBy(key).agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64(key), key).limit(limit)
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).join(F.broadcast(picked), key)


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Trees:
    sample = labelled_sample(docs, labels, label, allowed, limit, key, text)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2)):
            x = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["k", "y", "x"])

    measured = stage(sample.select(F.xxhash64(key).alias("k"), "y", text).mapInArrow(measure, "k long, y double, x array<double>"), "quality-sample").orderBy("k").toPandas()
    x = np.array(measured["x"].tolist(), dtype=float).reshape(len(measured), len(FEATURES))
    return fit(x, measured["y"].to_numpy())


def score(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row of ``docs``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(statistics(b.column(1))))], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(apply, f"`{key}` {kind}, score double")
