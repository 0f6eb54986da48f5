"""Toxicity: a gapped-subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel compares two words by their common subsequences of three characters
whose gaps are at most two, each weighted ``DECAY`` a skipped character and
normalised for length; so an insult still matches with a suffix, a dropped
letter or inserted letters.  Characters are code points.  Inserted characters
that are no letters or digits may be any number: behind a text stand its words
without them (also without zero-width and format characters, and without letters
of other scripts than Latin), and its runs of three or more single letters, joined
(``unmasked``).  A word cut into pieces of two letters and more by white space is
not joined.  An SVM is trained in the Nyström space of
``LANDMARKS`` words.  Its decision function is a sum over landmarks of kernel
values, and a kernel value is a dot product over 3-character codes, so the sum
folds into one table of 64**3 weights.  Scoring is nine table lookups a character,
exactly the landmark expansion, in numpy over whole batches.

Training labels mark whole texts.  A word is a positive example if a stem of it
(its first 4 to 8 characters, or all of it) stands in toxic training texts far
oftener than in others; all other words are negative, and words of clean texts
that score highest are added as negatives in a second round.  A text's score is
a logistic function, fitted on the training texts, of its highest word margin.
The sample of labelled texts is bounded (``SAMPLE``); scoring covers every whole
text.

Defined cases: null and empty texts score as texts without any evidence; with
no labels, or of one class only, every score is that class's share (0.5 for
none); equal rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.quality import labelled_sample
from weft.llm.stages import forget, stage
from weft.llm.tokens import Words, slices

SAMPLE = 20_000
LANDMARKS = 256
EXAMPLES = 6_000  # words of either class that the SVM sees, at most
DECAY = 0.6
STEMS = (4, 5, 6, 7, 8)
CODES = 64

#: Character classes: letters fold case, accents and common digit substitutions; letters of other scripts
#: share 32 classes, and all that is neither letter nor digit is one class, a character of any number of bytes.
_CLASS = np.full(128, 61, np.int64)
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = 1 + _i
for _a, _b in zip(b"013457@$", b"oieastas"):
    _CLASS[_a] = _b - 96
for _a in b"2689":
    _CLASS[_a] = 27
SPAN = 12  # letters of a spelled-out run that are one word


@lru_cache(1)
def _wide() -> np.ndarray:
    """Class of every code point below 0x20000."""
    out = np.full(0x20000, 61, np.int64)
    out[:128] = _CLASS
    for i in range(128, 0x20000):
        c = chr(i)
        if c.isalnum():
            base = ord(unicodedata.normalize("NFKD", c)[0])
            out[i] = _CLASS[base] if base < 128 else 29 + (i & 0x1F)
    return out


def _class_of(points: np.ndarray) -> np.ndarray:
    if not len(points) or points.max() < 128:
        return _CLASS[points]
    return np.where(points < 0x20000, _wide()[np.minimum(points, 0x1FFFF)], 29 + (points & 0x1F))


def _points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where characters start, their code points) of UTF-8 bytes."""
    start = np.flatnonzero((raw & 0xC0) != 0x80)
    more = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
    lead = more[start]
    wide = np.flatnonzero(lead >= 0xC0)
    at, c = start[wide], lead[wide]
    x, y, z = (more[at + i] & 0x3F for i in (1, 2, 3))
    lead[wide] = np.where(c < 0xE0, (c & 0x1F) << 6 | x, np.where(c < 0xF0, (c & 0x0F) << 12 | x << 6 | y, (c & 0x07) << 18 | x << 12 | y << 6 | z))
    return start, lead


@lru_cache(1 << 16)
def _plain(word: str) -> tuple[str, ...]:
    """What a word may hide: it without separators, zero-width and format characters, and without all that is not Latin."""
    full = [c for c in unicodedata.normalize("NFKD", word) if c.isalnum()]
    found = ["".join(full), "".join(c for c in full if c < "\x80")]
    core = word.strip(string.punctuation)
    if "@" in core or "$" in core:
        found.append("".join(c for c in word if c.isalnum() or c in "@$"))
    return tuple(dict.fromkeys(f for f in found if len(f) >= 3 and len(f) != len(core)))


#: Words that hide nothing: ASCII letters and digits, and letters that are one of these and a mark.
_MARKED = "".join(chr(i) for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(i))) == 2 and d[0].isascii() and d[0].isalpha() and not d[1].isalnum())
_OPEN = re.compile(f"[0-9A-Za-z{_MARKED}]*").fullmatch

#: Three or more single letters or digits with anything else between them, white space too.
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]++[^\W_](?![^\W_])){2,}+")


def unmasked(texts: pa.Array) -> pa.Array:
    """``texts``, each with the words behind it that inserted characters hide."""
    out, changed = [], False
    for text in texts.to_pylist():
        if text:
            if isinstance(text, bytes):
                text = text.decode("utf-8", "replace")
            hidden = {h for w in set(text.split()) if not _OPEN(w.strip(string.punctuation)) for h in _plain(w)}
            for m in _SPELLED.finditer(text):
                letters = "".join(c for c in m.group() if c.isalnum())
                if any(c.isalpha() for c in letters):
                    hidden.update(letters[i : i + SPAN] for i in range(0, max(1, len(letters) - SPAN + 4), 4))
            if hidden:
                text, changed = f"{text} {' '.join(sorted(hidden))}", True
        out.append(text)
    return pa.array(out, pa.large_string()) if changed else texts


_GAPS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]


def _length_norm(length: np.ndarray) -> np.ndarray:
    total = np.zeros(len(length))
    for a, b in _GAPS:
        total += np.maximum(length - (a + b), 0) * DECAY ** (2 * (a + b - 2))
    return np.sqrt(np.maximum(total, 1.0))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse kernel features of words: (word, code, weight), normalised for length."""
    rows, codes, weights = [], [], []
    for i, word in enumerate(words):
        c = _class_of(_points(np.frombuffer(word.encode("utf-8", "replace"), np.uint8))[1])
        norm = float(_length_norm(np.array([len(c)]))[0])
        for a, b in _GAPS:
            n = len(c) - a - b
            if n > 0:
                codes.append((c[:n] * CODES + c[a : a + n]) * CODES + c[a + b : a + b + n])
                weights.append(np.full(n, DECAY ** (a + b - 2) / norm))
                rows.append(np.full(n, i))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """(words, landmarks) matrix of kernel values."""
    r, c, v = word_features(landmarks)
    used, at = np.unique(c, return_inverse=True)  # only codes that landmarks have
    table = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(table, (at, r), v)
    place = np.full(CODES**3, -1, np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    r, c, v = word_features(words)
    keep = place[c] >= 0
    r, c, v = r[keep], place[c[keep]], v[keep].astype(np.float32)
    for lo in range(0, len(r), 4096):
        part = slice(lo, lo + 4096)
        first = np.flatnonzero(np.r_[True, np.diff(r[part]) != 0])  # a word's features stand together
        out[r[part][first]] += np.add.reduceat(table[c[part]] * v[part][:, None], first, axis=0)
    return out.astype(float)


class Model:
    """Folded decision function and the calibration of a text's highest margin."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float, constant: float | None = None):
        self.weights, self.bias, self.slope, self.offset, self.constant = weights, bias, slope, offset, constant

    def word_margins(self, texts: pa.Array) -> tuple[Words, np.ndarray]:
        w = Words(texts, hashes=False)
        if not len(w.start):
            return w, np.zeros(0)
        size = w.end - w.start
        at = np.cumsum(size) - size
        raw = w.data[np.arange(int(size.sum())) - np.repeat(at, size) + np.repeat(w.start, size)]
        start, points = _points(raw)
        code = _class_of(points).astype(np.int32)
        at = np.searchsorted(start, at)  # in characters from here on
        length = np.diff(np.append(at, len(code)))
        inside = np.arange(len(code)) - np.repeat(at, length)
        room = np.repeat(length, length) - inside
        total = np.zeros(len(code), np.float32)
        table = self.weights
        for a, b in _GAPS:
            n = len(code) - a - b
            if n <= 0:
                continue
            ok = np.flatnonzero(room[:n] > a + b)
            total[ok] += np.float32(DECAY ** (a + b - 2)) * table[(code[ok] * CODES + code[ok + a]) * CODES + code[ok + a + b]]
        return w, np.add.reduceat(total, at).astype(float) / _length_norm(length) + self.bias

    def text_margins(self, texts: pa.Array) -> tuple[np.ndarray, Words, np.ndarray]:
        """Highest word margin a text; texts without words get the margin of no evidence."""
        w, margin = self.word_margins(unmasked(texts))
        n = len(w.offsets) - 1
        top, where = np.full(n, self.bias), np.full(n, -1)
        some = np.flatnonzero(np.diff(w.first) > 0)
        if len(some):
            top[some] = np.maximum.reduceat(margin, w.first[some])
            doc = w.doc_of_word()
            hit = np.flatnonzero(margin == top[doc])
            where[doc[hit[::-1]]] = hit[::-1]
        return top, w, where

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        top, _, _ = self.text_margins(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.offset, -35, 35)))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 3000.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the active set; weights sum to 1."""
    n, m = x.shape
    xb = np.hstack([x, np.ones((n, 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    weight = weight * cost
    w = np.zeros(m + 1)
    ridge = np.full(m + 1, 1.0)
    ridge[-1] = 1e-3
    for turn in range(steps):
        active = sign * (xb @ w) < 1
        a = xb[active] * weight[active][:, None]
        new = np.linalg.solve(a.T @ xb[active] + np.diag(ridge), a.T @ sign[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * w + 0.5 * new if turn > 10 else new
    return w[:-1], float(w[-1])


def pick_landmarks(words: list[str], weight: np.ndarray, n: int) -> list[str]:
    """Pivoted incomplete Cholesky: the word that the chosen ones explain least, weighted, comes next."""
    pool = np.argsort(-weight, kind="stable")[: 6 * n]
    names = [words[i] for i in pool]
    k = kernel(names, names)
    left, chosen = np.diag(k).copy(), []
    rows = np.zeros((n, len(names)))
    for turn in range(min(n, len(names))):
        at = int(np.argmax(left * weight[pool]))
        if left[at] < 1e-4:
            break
        chosen.append(names[at])
        rows[turn] = (k[at] - rows[:turn, at] @ rows[:turn]) / np.sqrt(left[at])
        left = np.maximum(left - rows[turn] ** 2, 0)
    return chosen


def nystrom_svm(positive: list[str], seen: np.ndarray, negative: list[str]) -> tuple[np.ndarray, float]:
    """Folded weights over 3-character codes, and the bias.  ``seen``: toxic texts that hold each positive word."""
    strength = np.sqrt(seen.astype(float))
    landmarks = pick_landmarks(positive, strength, LANDMARKS * 3 // 4) + pick_landmarks(negative, np.ones(len(negative)), LANDMARKS // 4)
    k = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = kernel(positive + negative, landmarks) @ root
    share = np.r_[0.5 * strength / strength.sum(), np.full(len(negative), 0.5 / max(1, len(negative)))]
    w, bias = fit_svm(x, np.r_[np.ones(len(positive)), np.zeros(len(negative))], share * 2)
    gamma = root @ w  # weight of each landmark's kernel value
    table = np.zeros(CODES**3)
    r, c, v = word_features(landmarks)
    np.add.at(table, c, v * gamma[r])
    return table.astype(np.float32), bias


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, lightly regularised."""
    centre, scale = float(np.median(margin)), float(margin.std() + 1e-9)
    z = np.stack([(margin - centre) / scale, np.ones(len(y))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(h, z.T @ (y - p) - np.array([1e-2, 1e-4]) * w)
        w += np.clip(step, -2, 2)
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, word, toxic) once a text, of a batch of (text, y)."""
    word = re.compile(r"\w+")
    for b in batches:
        for part in slices(b, 0):
            stem, toxic = [], []
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = {w for w in word.findall((text or "").lower()) if 3 <= len(w) <= 40}
                grams = {w[:n] + "*" for w in words for n in STEMS if len(w) > n} | words
                stem += grams
                toxic += [int(y)] * len(grams)
            yield pa.RecordBatch.from_arrays([pa.array(stem, pa.string()), pa.array(toxic, pa.int32())], names=["stem", "toxic"])


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    sample = stage(labelled_sample(docs, labels, label, allowed, limit, key, text).select(F.xxhash64(key).alias("k"), text, "y").repartition(24, "k"), "toxic-sample")
    counts = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, n_toxic = int(counts[0]), float(counts[1] or 0)
    if n == 0 or n_toxic in (0.0, float(n)):
        return Model(np.zeros(CODES**3, np.float32), 0.0, 1.0, 0.0, n_toxic / n if n else 0.5)
    base = n_toxic / n
    seen = stage(sample.select(text, "y").mapInArrow(_stems, "stem string, toxic int").groupBy("stem").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")), "toxic-stems")
    # z-score of a stem's toxic texts against the base rate; bounded by EXAMPLES
    z = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 0.5)
    strong = seen.where((F.col("t") >= 3) & (F.col("t") > 0.6 * F.col("n"))).withColumn("z", z).where("z > 4").orderBy(F.desc("z"), "stem").limit(EXAMPLES).toPandas()
    whole = set(strong.loc[~strong["stem"].str.endswith("*"), "stem"])
    roots = {s[:-1] for s in strong["stem"] if s.endswith("*")}
    # a stem is evidence only if its longer forms, or it alone, carry it: take words of the sample under it
    words = seen.where(~F.col("stem").endswith("*"))
    under = words.where(F.substring("stem", 1, STEMS[0]).isin(sorted({r[: STEMS[0]] for r in roots} | {w[: STEMS[0]] for w in whole}) or [""])).where("t > 0.5 * n").orderBy(F.desc("t"), "stem").limit(4 * EXAMPLES).toPandas()
    found = under[[w in whole or any(w[:m] in roots for m in STEMS) for w in under["stem"]]].head(EXAMPLES)
    if not len(found):  # too few texts for evidence: the words that lean most towards toxic ones
        found = words.withColumn("z", z).orderBy(F.desc("z"), "stem").limit(50).toPandas()
    positive, seen_in = found["stem"].tolist(), found["t"].to_numpy()
    taken = set(positive)
    clean = words.where("t <= 0.5 * n").orderBy(F.xxhash64("stem"), "stem").limit(EXAMPLES).toPandas()["stem"].tolist()
    common = words.where("t <= 0.5 * n").orderBy(F.desc("n"), "stem").limit(EXAMPLES // 2).toPandas()["stem"].tolist()
    negative = [w for w in dict.fromkeys(common + clean) if w not in taken]
    model = margins = None
    for last in (False, False, True):
        table, bias = nystrom_svm(positive, seen_in, negative)
        model = Model(table, bias, 1.0, 0.0)

        def best(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            for b in (part for whole in batches for part in slices(whole, 0)):
                top, w, where = model.text_margins(b.column(0))
                which = [w.word_bytes(i).decode("utf-8", "replace") if i >= 0 else "" for i in where]
                yield pa.RecordBatch.from_arrays([pa.array(top), b.column(1), pa.array(which, pa.string())], names=["m", "y", "w"])

        margins: pd.DataFrame = sample.select(text, "y").mapInArrow(best, "m double, y double, w string").toPandas()
        if last:
            break
        hard = margins.loc[(margins["y"] == 0), ["m", "w"]].sort_values(["m", "w"], ascending=False)["w"].str.lower().str.strip(".,;:!?\"'()|*$%&#")
        negative = list(dict.fromkeys(negative + [w for w in dict.fromkeys(hard.head(3000)) if w and w not in taken]))
    forget(sample, seen)
    slope, offset = _calibrate(margins["m"].to_numpy(), margins["y"].to_numpy())
    return Model(model.weights, model.bias, slope, offset)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row of ``docs``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)), pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(apply, f"`{key}` {kind}, score double")


def keep_below(docs: DataFrame, model: Model, limit: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, in one pass and with all their columns."""
    at = docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, at)):
            yield b.filter(pa.array(model.score(b.column(at)) < limit))

    return docs.mapInArrow(apply, docs.schema)
