"""The pipeline as a chain over small tables with nulls, repeated rows, long texts and clashing columns, stage by stage against brute force."""

import collections
import random

import pytest

from tests.llm.test_operators import brute_components, documents, prose, sort

pipeline = pytest.importorskip("corpus_pipeline")

from weft.llm.stages import stage  # noqa: E402

ITEM = "the seventh river carries more copper than silver into the northern lake every spring"


def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randrange(20, 90)), f"src{i % 3}") for i in range(90)]
    base = prose(rng, 80).split()
    for i in range(90, 100):  # near copies
        words = list(base)
        words[i - 90] = "edited"
        out.append((i, " ".join(words), "src0"))
    out += [(100, out[3][1], "src1"), (101, out[3][1], None)]  # exact copies
    out += [(110 + i, f"{prose(rng, 20)} {ITEM} {prose(rng, 20)}", "src2") for i in range(4)]  # leaks
    out += [(200 + i, f"{prose(rng, 12)} you grubblewit {prose(rng, 12)}", "src1") for i in range(60)]  # toxic
    out += [(None, prose(rng, 30), "src0"), (None, f"{prose(rng, 20)} {ITEM}", "src0"), (None, None, None), (300, "", "src1"), (301, " \n", "src1")]
    out += [(7, prose(rng, 25), "src1"), out[8], (302, prose(rng, 6000), "src2")]  # a repeated key, a repeated row, a long text
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    labels = [(r[0], 1, int("grubblewit" in (r[1] or ""))) for r in rows() if r[0] is not None and r[0] < 250]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def pairs(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages_on_hard_rows(spark, folder):
    docs = documents(spark, rows())
    now, kept = docs, {}
    for name, step in pipeline.STAGES:
        before = now
        now = stage(step(spark, now, folder), f"hard-{name}")
        assert now.columns == docs.columns if name != "sharding" else set(now.columns) == set(docs.columns) | {"slot"}
        kept[name] = (pairs(before), pairs(now))
    before, after = kept["toxicity"]
    assert sort(after) == sort(r for r in before if "grubblewit" not in (r[1] or ""))
    before, after = kept["ngram_jaccard_join"]
    assert set(after) <= set(before)
    names = collections.Counter(c for k, _, c in brute_components([(i, r[1]) for i, r in enumerate(before)]))
    alone = {(before[i][0], before[i][1]) for i in names}
    assert len(after) == len({(before[i][0], before[i][1]) if before[i][1] and before[i][1].strip() else (before[i][0], before[i][1], "empty") for i in names})
    assert {(k, t) for k, t, _ in after if k is not None and not 90 <= k < 102} <= alone
    before, after = kept["benchmark_decontamination"]
    assert sort(after) == sort(r for r in before if ITEM not in (r[1] or "")) and any(ITEM in (r[1] or "") for r in before)
    before, after = kept["mixing"]
    copies = collections.Counter(after)
    assert set(copies) <= set(before) and all(n <= 3 for r, n in copies.items() if before.count(r) == 1)
    before, after = kept["sharding"]
    assert sort(before) == sort(after)
    for _, part in now.toPandas().groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_stages_on_an_empty_table(spark, folder):
    now = documents(spark, rows()).limit(0)
    for name, step in pipeline.STAGES:
        now = stage(step(spark, now, folder), f"empty-{name}")
        assert now.count() == 0
