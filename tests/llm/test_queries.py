"""The registered queries and the pipeline, over whole tables."""

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from weft.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet")


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, FOLDER).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_op3_op7_op9_against_brute_force(spark, docs):
    from tests.llm.test_operators import brute_bytes, brute_components, brute_phrases, sort
    import hashlib

    rows = list(zip(docs["doc_id"].tolist(), docs["text"].tolist()))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = QUERIES["op3_phrase_dedup"](spark, FOLDER).collect()
    assert sort(tuple(r) for r in got) == sort((k, n, m, digest(t.encode())) for k, n, m, t in brute_phrases(rows))
    got = QUERIES["op9_suffix_dedup"](spark, FOLDER).collect()
    assert sort(tuple(r) for r in got) == sort((k, n, m, s, digest(b)) for k, n, m, s, b in brute_bytes(rows, 400))
    got = QUERIES["op7_jaccard_join"](spark, FOLDER).collect()
    assert sort(tuple(r) for r in got) == sort(brute_components(rows))


@pytest.mark.parametrize("name,columns", [("op1_toxicity", {"doc_id", "held_out", "score", "predicted"}), ("op10_quality", {"doc_id", "held_out", "score", "predicted"}), ("op5_sharding", {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}), ("op6_mixing", {"doc_id", "size", "source_size", "target", "taken"})])
def test_one_row_a_document(spark, docs, name, columns):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert set(got.columns) == columns and sorted(got["doc_id"]) == sorted(docs["doc_id"])


def test_op5_against_brute_force(spark, docs):
    got = QUERIES["op5_sharding"](spark, FOLDER).toPandas()
    raw = lambda t: (t or "").encode()
    want = sorted((int(k), len(raw(t)) + 1, zlib.crc32(raw(t))) for k, t in zip(docs["doc_id"], docs["text"]))
    assert sorted(zip(got["doc_id"], got["size"], got["text_crc32"])) == want
    assert set(got["law"]) == {"key"} and set(got["shard"]) <= set(range(16))
    assert ((got["grown_shard"] == got["shard"]) | (got["grown_shard"] == 16)).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_op6_against_brute_force(spark, docs):
    got = QUERIES["op6_mixing"](spark, FOLDER).toPandas().set_index("doc_id")
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in zip(docs["doc_id"], docs["text"])}
    source = dict(zip(docs["doc_id"], docs["source"]))
    held = {}
    for k, s in source.items():
        held[s] = held.get(s, 0) + size[k]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(held, key=lambda s: (s is None, s or "")))}
    target, free = dict.fromkeys(held, 0.0), set(held)
    left = float(sum(held.values()))
    while free and left > 1e-6:  # share by weight, cut at three times the size, share the excess again
        share, total = left, sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=str):
            target[s] += share * weight[s] / total
        for s in list(free):
            if target[s] > 3 * held[s]:
                left += target[s] - 3 * held[s]
                target[s] = 3.0 * held[s]
                free.discard(s)
    taken = dict.fromkeys(held, 0)
    for k in size:
        row = got.loc[k]
        assert row["size"] == size[k] and row["source_size"] == held[source[k]] and abs(row["target"] - target[source[k]]) < 1e-3
        assert 0 <= row["taken"] <= 3 * size[k] and (row["taken"] % size[k] == 0 if size[k] else row["taken"] == 0)
        taken[source[k]] += row["taken"]
    for s in held:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 60


@pytest.mark.parametrize("name,label,modulus,rest,cut,least", [("op1_toxicity", "toxic", 5, 0, 0.5, 0.9), ("op10_quality", "quality", 4, 2, 0.7, 0.75)])
def test_held_out_accuracy(spark, name, label, modulus, rest, cut, least):
    folder = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, folder).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(k).encode()) % modulus == rest for k in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= cut).astype(int)).all()
    rows = got.merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    rows = rows[rows["held_out"]]
    right = ((rows["score"] >= 0.5).astype(int) == rows[label]).mean()
    print(name, "held-out rows", len(rows), "share right at 0.5", round(float(right), 4))
    assert right >= least


def test_op2_and_op8(spark, docs):
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    squash = lambda t: " ".join(t.lower().split())
    exact = {(d, i) for d, t in zip(docs["doc_id"], docs["text"]) for i, b in zip(items["item_id"], items["text"]) if squash(b) in squash(t)}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontamination"](spark, FOLDER).collect()}
    assert exact <= got
    lines = {d for d, t in zip(docs["doc_id"], docs["text"]) if "Released under the MIT License." in t}
    assert lines <= {r["doc_id"] for r in QUERIES["op8_licenses"](spark, FOLDER).where("license = 'MIT'").collect()}


def test_pipeline(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert len(pipeline.STAGES) == 5
    from weft.llm.stages import stage, table

    now = table(spark, FOLDER, "documents")
    kept = []
    for name, step in pipeline.STAGES:
        before = {r["doc_id"] for r in now.select("doc_id").collect()}
        now = stage(step(spark, now, FOLDER), f"test-{name}")
        after = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert after <= before
        if name != "sharding":
            assert now.columns == list(docs.columns)
        kept.append(len(after))
    assert kept[0] > 0.8 * len(docs) and kept[1] > 0.7 * kept[0] and kept[2] > 0.8 * kept[1]
    out = now.toPandas()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    again = pipeline.run(spark, FOLDER).toPandas()
    assert sorted(zip(out["doc_id"], out["shard"])) == sorted(zip(again["doc_id"], again["shard"]))
