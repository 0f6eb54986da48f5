"""Operators of the training-data pipeline against brute force on small inputs, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import decontam, jaccard, licenses, mixing, phrases, quality, repeats, sharding, suffixes, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, target string, key string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """(doc_id, text[, source]) rows with columns that clash with what operators add."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "y", "z", "k") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, nulls, empty ones, ties of keys and rows."""
    rng = random.Random(seed)
    shared = prose(rng, 40)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            text = prose(rng, rng.randrange(5, 30)) + "\n" + shared + " " + prose(rng, rng.randrange(0, 30))
        elif kind == 3 and rows:
            words = (rows[rng.randrange(len(rows))][1] or "").split()
            if words:
                words[rng.randrange(len(words))] = "edited"
            text = "  ".join(words)
        else:
            text = prose(rng, rng.randrange(0, 120))
        rows.append((i, text, f"src{i % 4}"))
    rows += [(n, None, None), (n + 1, "", "src0"), (n + 2, " \t\n", "src0"), (n + 3, "É" * 500, None), (n + 4, "a" * 1500, "src1"), (None, rows[2][1], "src2"), rows[5], rows[5]]
    rows.append((n + 6, (shared + " ") * 30 + prose(rng, 4000), "src3"))
    return rows


# --- kernels ---


def test_words_and_grams():
    texts = pa.array(["a bb\tccc", None, "", "bb ccc a", "x"])
    w = tokens.Words(texts)
    assert w.first.tolist() == [0, 3, 3, 3, 6, 7]
    assert w.hash[1] == w.hash[3] and w.hash[2] == w.hash[4] and w.hash[0] == w.hash[5]
    g = tokens.grams(w.hash, 2)
    assert g[1] == g[3] and len(set(g.tolist())) == 5
    assert tokens.starts_of_grams(w.first, 2).tolist() == [True, True, False, True, True, False]
    sliced = pa.array(["zz", "a bb\tccc"]).slice(1)
    assert tokens.Words(sliced).hash.tolist() == w.hash[:3].tolist()


@pytest.mark.parametrize("w", [1, 2, 5, 8])
def test_minimizers(w):
    rng = np.random.default_rng(w)
    v = rng.integers(0, 6, 97).astype(np.uint64)
    want = [i + int(np.argmin(v[i : i + w])) for i in range(len(v) - w + 1)]
    assert tokens.minimizers(v, w).tolist() == want


def test_slices_cover_everything():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (5, 0, 100, 3, 50)]})
    assert [p.num_rows for p in tokens.slices(batch, 0, 60)] == [2, 1, 2]


# --- 3 and 9: repeated passages ---


def brute_phrases(rows, window=13):
    first = {}
    for key, text, *_ in rows:
        words = WORD.findall((text or "").encode())
        order = float("inf") if key is None else key
        for i in range(len(words) - window + 1):
            gram = tuple(words[i : i + window])
            first[gram] = min(first.get(gram, order), order)
    out = []
    for key, text, *_ in rows:
        words = WORD.findall((text or "").encode())
        order = float("inf") if key is None else key
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < order:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((key, len(words), sum(gone), kept.decode()))
    return out


def brute_bytes(rows, depth):
    count = collections.Counter(t[i : i + depth] for t in ((r[1] or "").encode() for r in rows) for i in range(len(t) - depth + 1))
    out = []
    for key, text, *_ in rows:
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if count[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        out.append((key, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def sort(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("hot", [10_000, 3])
def test_phrases(spark, monkeypatch, hot):
    monkeypatch.setattr("weft.llm.repeats.HOT", hot)
    monkeypatch.setattr("weft.llm.repeats.BUCKET", 4000)
    rows = corpus()
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in phrases.remove_repeats(documents(spark, rows)).collect()]
    assert sort(got) == sort(brute_phrases(rows))
    assert sum(r[2] for r in got) > 300


@pytest.mark.parametrize("hot", [10_000, 3])
def test_suffixes(spark, monkeypatch, hot):
    monkeypatch.setattr("weft.llm.repeats.HOT", hot)
    monkeypatch.setattr("weft.llm.repeats.BUCKET", 4000)
    rows = corpus(2)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(documents(spark, rows), depth=60).collect()]
    assert sort(got) == sort(brute_bytes(rows, 60))
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("kind", ["phrases", "suffixes"])
def test_hot_windows_recur_by_content(spark, monkeypatch, kind):
    """Window hashes that are all equal drop nothing and remove nothing."""
    module = {"phrases": phrases, "suffixes": suffixes}[kind]

    class Colliding(module._Text):
        def windows(self, *runs):
            run, window, h, anchor, *rest = super().windows(*runs)
            return run, window, np.zeros_like(h), np.zeros_like(anchor), *rest

    monkeypatch.setattr(module, "_Text", Colliding)
    monkeypatch.setattr("weft.llm.repeats.HOT", 3)
    monkeypatch.setattr("weft.llm.repeats.BUCKET", 4000)
    rows = corpus(3)
    if kind == "phrases":
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in phrases.remove_repeats(documents(spark, rows)).collect()]
        assert sort(got) == sort(brute_phrases(rows))
    else:
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(documents(spark, rows), depth=60).collect()]
        assert sort(got) == sort(brute_bytes(rows, 60))


def test_hot_passage_of_many_windows(spark, monkeypatch):
    monkeypatch.setattr("weft.llm.repeats.HOT", 3)
    rng = random.Random(4)
    long = prose(rng, 14_000, 9_000)
    assert len(long) > 70_000
    rows = [(i, prose(rng, 30) + long + prose(rng, 30), "s") for i in range(6)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(documents(spark, rows), depth=60).collect()]
    assert sort(got) == sort(brute_bytes(rows, 60))


def test_radix_groups():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    at = np.arange(4000 - 16 + 1)
    count = collections.Counter(data[i : i + 16].tobytes() for i in at)
    want = {int(i) for i in at if count[data[i : i + 16].tobytes()] > 1}
    assert set(suffixes.radix_groups(data, at, 16).tolist()) == want


# --- 7: Jaccard join ---


def brute_components(rows):
    sets = [jaccard.shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard.linked(sets[i], sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(groups[find(i)]) if groups[find(i)] else None) for i, r in enumerate(rows)]


def near_copies(seed, n=40):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice((3, 8, 60, 150, 400)), 5000).split() for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(words) // 40)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "\n".join(words)))
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard(spark, seed):
    rows = [r[:2] for r in corpus(seed, 30)] + [(1000 + k, t) for k, t in near_copies(seed)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(documents(spark, rows)).collect()]
    assert sort(got) == sort(brute_components(rows))


@pytest.mark.parametrize("seed,growth", [(11, 2), (12, 4), (13, 100)])
def test_jaccard_by_every_way(spark, monkeypatch, seed, growth):
    """Colliding ids, ids that tasks pass by, many ranges, many and few rounds, and links close to the threshold."""
    for name, value in (("ID_BITS", 9), ("LOCAL", 2), ("BUCKET", 2000), ("FLUSH", 3000), ("GROWTH", growth), ("SMALL", 0 if growth == 4 else 1000)):
        monkeypatch.setattr(f"weft.llm.jaccard.{name}", value)
    rng = random.Random(seed)
    rows = []
    for group in range(6):
        base = [f"g{rng.randrange(900)}" for _ in range(rng.randrange(6, 90))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 14))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
            rows.append((len(rows), " ".join(words[: len(words) - rng.randrange(3)])))
    rows += [(len(rows), rows[0][1]), (3, rows[3][1]), (None, rows[5][1]), (len(rows) + 5, "")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(documents(spark, rows)).collect()]
    assert sort(got) == sort(brute_components(rows))


def test_one_of_each(spark):
    rows = near_copies(5) + [(None, "some words of a text without a key here"), (900, None), (901, "")]
    rows += [(None, rows[0][1]), rows[1], rows[1], rows[41]]
    kept = [r["doc_id"] for r in jaccard.one_of_each(documents(spark, rows)).collect()]
    want = {c for k, n, c in brute_components(rows) if k is not None}
    assert sorted(k for k in kept if k is not None) == sorted(want) and kept.count(None) == 1


@pytest.mark.parametrize("small", [100_000, 0])
def test_components_of_long_chains(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    roots = {r["id"]: r["root"] for r in jaccard.components(edges, "chain").collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, 101: 100}
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    least = {i: i for p in pairs for i in p}
    for _ in range(60):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["id"]: r["root"] for r in jaccard.components(spark.createDataFrame(pairs, "a long, b long"), "random").collect()}
    assert got == {i: m for i, m in least.items() if i != m}


@pytest.mark.parametrize("small", [100_000, 0])
def test_many_texts_under_one_key(spark, monkeypatch, small):
    monkeypatch.setattr("weft.llm.repeats.SMALL", small)
    rows = [(7, f"text number {i} stands alone") for i in range(3000)] + [(None, f"row {i} has no key") for i in range(20)] + [(8, "once"), (-1, "below"), (-1, "zero"), (1 << 60, "large")]
    docs = documents(spark, rows + rows[:2])
    ids = repeats.with_row_id(docs, "rid").select("rid", "doc_id", "text").distinct().collect()
    assert len({r["rid"] for r in ids}) == len(ids) == len(rows)
    assert small == 0 or {r["rid"] for r in ids} >= {8, 1 << 60}
    if small:
        left = jaccard.one_of_each(docs).collect()
        assert sort((r["doc_id"], r["text"]) for r in left) == sort(rows)
        parts = [[f"k{i}w{j}" for j in range(20)] for i in range(600)]
        rows = [(7, " ".join(p)) for p in parts] + [(9, " ".join(p[:15])) for p in parts]
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in phrases.remove_repeats(documents(spark, rows)).collect()]
        assert sort(got) == sort(brute_phrases(rows))


# --- 2: decontamination ---


def distance_to_substring(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(1)
    for _ in range(200):
        pattern = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 120)))
        want = distance_to_substring(pattern, text)
        assert decontam.Myers(pattern).best(text, 1000) == want
        assert decontam.Myers(pattern).best(text, 2) == min(want, 3)


def test_find_leaks(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, 30)) for i in range(8)] + [(8, None), (9, "..."), (10, "tiny"), (11, "Exact Case here")]
    rows = []
    for i in range(60):
        words = prose(rng, 60).split()
        if i % 2:
            leak = items[i % 8][1]
            for _ in range(i % 9):
                at = rng.randrange(len(leak))
                leak = leak[:at] + rng.choice(["", "q", "  "]) + leak[at + 1 :]
            words[20:20] = leak.upper().split()
        rows.append((i, " ".join(words)))
    rows += [(60, None), (61, ""), (62, "so tiny: it matches"), (63, "notiny"), (64, "EXACT,case HERE"), (64, "EXACT,case HERE"), (None, items[0][1])]
    got = sort((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = {}
    for key, text in rows:
        body = decontam.normalised(text)
        for item_id, item in items:
            pattern = decontam.normalised(item)
            if body and pattern:
                d = distance_to_substring(pattern, body)
                if d <= decontam.budget(pattern):
                    want[(key, item_id)] = min(d, want.get((key, item_id), 99))
    assert got == sort((*k, d) for k, d in want.items())
    assert len(got) > 20
    clean = decontam.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == documents(spark, rows).columns
    assert sort(r["doc_id"] for r in clean.collect()) == sort(k for k, _ in rows if k not in {g[0] for g in got})


def test_leaks_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 1)
    items = spark.createDataFrame([(0, "alpha beta gamma"), (1, "delta epsilon")], "item_id long, text string")
    chunk = decontam.chunks(items, "item_id", "text", 1)
    assert [len(c) for c in chunk] == [1, 1]
    none = decontam.find_leaks(documents(spark, [(0, "alpha beta gamma")]), items.limit(0))
    assert none.count() == 0


@pytest.mark.parametrize("limit", [8 << 20, 1])
def test_leaky_rows_leave_others_of_their_key(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam.chunks, "__defaults__", (limit,))
    items = spark.createDataFrame([(0, "alpha beta gamma"), (1, "delta epsilon")], "item_id long, text string")
    rows = [(None, "has alpha beta gamma"), (None, "clean"), (None, None), (7, "delta epsilon here"), (7, "also clean"), (7, "also clean"), (8, "")]
    left = decontam.decontaminate(documents(spark, rows), items).collect()
    assert sort((r["doc_id"], r["text"]) for r in left) == sort([rows[1], rows[2], rows[4], rows[5], rows[6]])


# --- 8: licenses ---


def test_licenses(spark):
    rng = random.Random(3)
    rows = []
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        rows.append((i, prose(rng, rng.randrange(0, 40)) + "\n" + text.upper() + "\n" + prose(rng, rng.randrange(0, 40)), name))
    rows += [(100, prose(rng, 200)), (101, None), (102, ""), (103, "MIT License"), (104, "reserved. rights All"), (105, rows[0][1]), (105, rows[0][1])]
    found = collections.defaultdict(set)
    for r in licenses.scan_licenses(documents(spark, rows)).collect():
        found[r["doc_id"]].add(r["license"])
        assert r["containment"] == 1.0
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert name in found[i]
    assert not any(found[k] for k in (100, 101, 102, 103, 104)) and found[105] == found[0]


def test_license_containment_is_exact():
    index = licenses.Index((("T", " ".join(f"t{i}" for i in range(40))),))
    whole = [f"t{i}" for i in range(40)]
    cut = whole[:37] + ["x"] + whole[38:]
    found = index.scan(pa.array([" ".join(["a"] * 9 + cut + ["b"] * 9), " ".join(whole[:20])]))
    want = len({tuple(cut[i : i + 5]) for i in range(36)} & index.shingles[0]) / 36
    assert found == {(0, "T"): (want, 9)}


# --- 4: top-k ---


def brute_top(rows, k):
    q = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for own, a in sorted({(i, tuple(v)) for i, v in q if i % 5 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in q if i != own)[:k]
        out += [(own, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("case", ["spread", "ties", "few", "empty"])
def test_top_k(spark, monkeypatch, case):
    monkeypatch.setattr(topk, "PAGE_ROWS", 40)
    monkeypatch.setattr(topk, "LEAF", 6)
    monkeypatch.setattr(topk, "QUERY_GROUP", 7)
    rng = np.random.default_rng(4)
    n = {"spread": 300, "ties": 200, "few": 3, "empty": 0}[case]
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(n)]
    if case == "ties":
        rows = [(i, [1.0] * 8 if i % 3 else v) for i, v in rows]
    if case != "empty":
        rows += [(1000, None), (1005, [1.0, None] + [0.0] * 6), (1010, [float("nan")] * 8), (1015, [float("inf")] * 8), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk.top_k(vectors, F.col("vec_id") % 5 == 0, 5)
    assert sort(tuple(r) for r in got.collect()) == sort(brute_top(rows, 5))


def test_queries_that_share_an_id_are_all_asked(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pooled = sorted((-65536 * sum(x * y for x, y in zip(a, b)), i) for o, a in rows if o == 0 for i, b in rows if i != 0)[:4]
    got = topk.top_k(vectors, F.col("vec_id") == 0, 4).collect()
    assert sort(tuple(r) for r in got) == sort((0, n + 1, i, int(-s)) for n, (s, i) in enumerate(pooled))


def test_scores_beyond_floats_and_empty_vectors(spark):
    rows = [(0, [1e7 + 0.5, 1.0]), (1, [1e7 + 0.25, 0.504]), (2, [1e7 + 0.25, 0.5]), (3, []), (4, [-1e7, 3.0]), (5, []), (6, [1e7 + 0.25, 0.508]), (7, [3e-3, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for own in (0, 5):
        scored = sorted((-sum(x * y for x, y in zip(q[own], q[i])), i) for i in q if i != own)[:7]
        want += [(own, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    got = topk.top_k(vectors, F.col("vec_id") % 5 == 0, 7).collect()
    assert sort(tuple(r) for r in got) == sort(want)


def test_tree_computes_less():
    rng = np.random.default_rng(5)
    centres = rng.integers(-100, 100, (40, 16))
    points = (centres[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 16))).astype(float)
    tree = topk.MTree(points, np.arange(4000))
    q = points[:50]
    best, _, computed = tree.search(q.astype(np.int64), np.arange(50), 5, np.full(50, topk.NONE), np.full(50, topk.LAST))
    s = (q @ points.T).astype(np.int64)
    s[np.arange(50), np.arange(50)] = topk.NONE
    assert (np.sort(s, 1)[:, -5:][:, ::-1] == best).all()
    assert computed < 0.6 * 50 * 4000


# --- 5: sharding ---


def test_hot_keys_and_equal_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL", 20)
    rng = random.Random(1)
    rows = [(None, prose(rng, 20)) for _ in range(200)] + [(7, "same text") for _ in range(150)] + [(i, prose(rng, 20)) for i in range(100)]
    docs = documents(spark, rows).withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    out = sharding.external_shuffle(docs, 4, bucket_bytes=1000)
    got = out.toPandas()
    assert collections.Counter(zip(got["doc_id"].fillna(-1), got["text"])) == collections.Counter((-1 if k is None else k, t) for k, t in rows)
    assert out.schema["extra"].dataType.simpleString() == "map<string,int>" and all(m == {"a": 1} for m in got["extra"])
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = {len(t) + 1 for _, t in rows}
    assert max(sizes) < 1000  # no bucket holds the rows of a key: slots of the equal rows lie all over their shard
    same = got[got["text"] == "same text"]
    assert same["shard"].nunique() == 1 and same["slot"].max() - same["slot"].min() > 150


def test_sharding(spark, tmp_path):
    rows = corpus(6)
    docs = documents(spark, rows)
    for size in (1 << 20, 500):
        out = sharding.external_shuffle(docs, 4, bucket_bytes=size).toPandas()
        assert len(out) == len(rows) and set(out.columns) == set(docs.columns) | {"slot"}
        for _, part in out.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        assert out["shard"].between(0, 3).all()
    again = sharding.external_shuffle(docs.repartition(7), 4, bucket_bytes=500).toPandas()
    key = lambda x: sorted(zip(x["doc_id"].fillna(-1), x["shard"], x["slot"]))
    assert key(again) == key(out)
    grown = docs.select(sharding.shard_of(F.col("doc_id"), 4).alias("a"), sharding.shard_of(F.col("doc_id"), 5).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["b"] == 4 for r in grown)
    assert sharding.external_shuffle(docs.limit(0), 4).count() == 0
    sharding.write_shards(sharding.external_shuffle(docs, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_shuffle_is_uniform(spark):
    docs = documents(spark, [(i, "same text") for i in range(4000)])
    out = sharding.external_shuffle(docs, 4, bucket_bytes=2000).toPandas()
    assert out.groupby("shard").size().between(850, 1150).all()
    assert abs(np.corrcoef(out["doc_id"], out["slot"])[0, 1]) < 0.1


# --- 6: mixing ---


def water_filled(sizes, weights=mixing.WEIGHTS, cap=mixing.CAP):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = cap * sizes[s]
            open_.discard(s)
    return target


def test_targets(spark):
    sizes = {"b": 10, "a": 1000, "c": 5, "É": 3000, "z": 0, None: 70}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = water_filled(sizes)
    assert {r["source"]: pytest.approx(want[r["source"]]) for r in got} == {r["source"]: r["target"] for r in got}


def test_flight_keeps_the_balance():
    rng = np.random.default_rng(7)
    p, size = rng.random(500), rng.integers(1, 1000, 500)
    out = mixing.flight(p, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and out @ size == pytest.approx(p @ size, rel=1e-9)
    draws = np.array([mixing.flight(np.full(8, 0.5), np.arange(1, 9), np.random.default_rng(i)) for i in range(2000)])
    assert np.abs(draws.mean(0) - 0.5).max() < 0.05


@pytest.mark.parametrize("block", [4096, 16])
def test_mix(spark, block):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 80)), f"s{i % 10 // 4}") for i in range(900)] + [(900, None, "s0"), (901, "", None), (902, "one two", None), (5, "a b c", "s0"), (5, "a b c", "s0")]
    docs = documents(spark, rows)
    out = mixing.mix(docs, block=block).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all() and (out.loc[out["size"] == 0, "taken"] == 0).all()
    for source, part in out.groupby("source", dropna=False):
        target = part["target"].iloc[0]
        assert part["source_size"].iloc[0] == part["size"].sum()
        assert abs(part["taken"].sum() - target) <= 0.01 * target + 3, source
    again = mixing.mix(docs.repartition(5), block=block).toPandas()
    assert sorted(zip(out["doc_id"], out["taken"])) == sorted(zip(again["doc_id"], again["taken"]))
    taken = mixing.take(docs, block=block)
    assert taken.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_take_decides_rows_that_share_a_key_one_by_one(spark):
    rng = random.Random(12)
    sizes = {"s0": 300, "s1": 900, "s2": 600}
    rows = [(None if i % 2 else 7, prose(rng, rng.randrange(1, 60)), s) for s, n in sizes.items() for i in range(n)]
    rows += [(None, "the same row", "s1")] * 40 + [(None, None, "s1"), (7, "", None)]
    docs = documents(spark, rows)
    words = lambda text: len((text or "").split())
    held = {s: sum(words(t) for _, t, x in rows if x == s) for s in sizes}
    want = water_filled({**held, None: 0})
    got = collections.Counter(tuple(r)[1::2][:2] for r in mixing.take(docs).select("doc_id", "text", "lang", "source").collect())
    most = collections.Counter((t, s) for _, t, s in rows)
    assert all(n <= 3 * most[row] for row, n in got.items())
    for source in sizes:
        assert abs(sum(n * words(t) for (t, s), n in got.items() if s == source) - want[source]) <= 0.01 * want[source] + 60, source
    again = mixing.take(docs.repartition(5)).select("doc_id", "text", "lang", "source").collect()
    assert got == collections.Counter(tuple(r)[1::2][:2] for r in again)


# --- 1 and 10: classifiers ---

INSULTS = ["grobnik", "plonkard", "wastrel"]


def labelled(seed=9, n=900):
    rng = random.Random(seed)
    syllables = ["an", "er", "on", "th", "re", "ing", "to", "es", "ion", "ha", "li", "mu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, toxic = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 80))]
        bad = i % 5 == 0
        if bad:
            insult = rng.choice(INSULTS)
            at = rng.randrange(3, len(insult) - 2)
            words[rng.randrange(len(words))] = rng.choice([insult, insult + word(), insult.capitalize() + ",", insult[:at] + "." + insult[at:]])
        rows.append((i, " ".join(words)))
        toxic.append((i, 1 - (i % 7 == 0), int(bad)))
    return rows, toxic


def test_toxicity(spark):
    rows, toxic = labelled()
    labels = spark.createDataFrame(toxic + [(10**6, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    extra = [(5000, None), (5001, ""), (5002, rows[0][1])]
    docs = documents(spark, rows + extra)
    allowed = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = toxicity.train(docs, labels, "toxic", allowed)
    out = toxicity.score(docs, model).toPandas().set_index("doc_id")["score"]
    assert len(out) == len(rows) + 3 and out.between(0, 1).all()
    held = [r["doc_id"] for r in labels.where(~allowed & (F.col("doc_id") < 900)).select("doc_id").distinct().collect()]
    truth = {i: t for i, _, t in toxic}
    hits = [(out[i] >= 0.5) == bool(truth[i]) for i in held]
    assert np.mean(hits) > 0.95
    assert out[5000] < 0.5 and out[5001] < 0.5 and out[5002] == out[0]
    kept = toxicity.keep_below(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == int((out < 0.5).sum())


def test_inserted_characters_do_not_hide_insults(spark):
    rows, toxic = labelled()
    model = toxicity.train(documents(spark, rows), spark.createDataFrame(toxic, "doc_id long, quality int, toxic int"), "toxic", F.lit(True))
    clean = [t for (_, t), (_, _, y) in zip(rows, toxic) if not y][:200]
    before = model.score(pa.array(clean))
    assert np.mean(before < 0.5) > 0.95
    base = next(t for t, p in zip(clean, before) if p < 0.3)
    for between in ("\u200b", "\u2022", "---", " ", "\U0001f600", "\u4e2d", ". ", "_", "\u00a0", "\u0301", "  *  "):
        hidden = [f"{base} {between.join(w)} {base}" for w in INSULTS]
        assert (model.score(pa.array(hidden)) >= 0.5).all(), repr(between)
    plain = ["don't", "x y", "a-b", "caf\u00e9", "end.", "1 2 3 4"]
    assert (model.score(pa.array([f"{base} {p}" for p in plain])) < 0.5).all()


def test_kernel_folds_exactly():
    words, landmarks = ["grobnik", "gr-obnik", "other", "ab", "É"], ["grobnik", "wastrel", "banana"]
    k = toxicity.kernel(words, landmarks)
    gamma = np.array([0.5, -1.0, 2.0])
    table = np.zeros(toxicity.CODES**3)
    r, c, v = toxicity.word_features(landmarks)
    np.add.at(table, c, v * gamma[r])
    model = toxicity.Model(table.astype(np.float32), 0.25, 1.0, 0.0)
    _, margin = model.word_margins(pa.array([" ".join(words)]))
    assert np.allclose(margin, k @ gamma + 0.25, atol=1e-5)
    assert k[0, 0] > k[1, 0] > 0.4 > k[2, 0]


@pytest.mark.parametrize("given", [[], [(0, 1, 1)], [(0, 1, 0), (1, 1, 0)]])
def test_one_class(spark, given):
    docs = documents(spark, [(0, "a b c d"), (1, "e f"), (2, None)])
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    share = float(np.mean([g[2] for g in given])) if given else 0.5
    model = toxicity.train(docs, labels, "toxic", F.lit(True))
    assert toxicity.score(docs, model).toPandas()["score"].tolist() == pytest.approx([share] * 3)
    trees = quality.train(docs, labels, "toxic", F.lit(True))
    assert quality.score(docs, trees).toPandas()["score"].tolist() == pytest.approx([share] * 3, abs=1e-5)


def test_quality(spark):
    rng = random.Random(10)
    rows, marks = [], []
    for i in range(800):
        good = i % 4 != 0
        words = prose(rng, rng.randrange(30, 90)).split()
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 == 0 else [words[0]] * len(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(good), 0))
    docs = documents(spark, rows + [(5000, None), (5001, ""), (5002, "\n\n")])
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, "quality", F.col("doc_id") % 3 != 0)
    out = quality.score(docs, model).toPandas().set_index("doc_id")["score"]
    held = [i for i in range(800) if i % 3 == 0]
    assert np.mean([(out[i] >= 0.7) == bool(marks[i][1]) for i in held]) > 0.98
    assert out.notna().all() and len(out) == 803


def test_trees_flatten_like_recursion():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y, rounds=10, depth=3)

    def walk(tree, row, node=0):
        f, t, left, right, value = (part[tree] for part in (model.feature, model.threshold, model.left, model.right, model.value))
        return value[node] if left[node] == node else walk(tree, row, left[node] if row[f[node]] <= t[node] else right[node])

    want = [model.base + sum(walk(t, r) for t in range(len(model.feature))) for r in x[:50]]
    assert np.allclose(model.margin(x[:50]), want)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
