"""The stateful cache stream against the batch replay."""

import pandas as pd

from weft.streaming import lru


def test_ttl_and_eviction():
    cache = lru.Lru(2, ttl=10)
    assert [cache.access(k, t) for k, t in ((1, 0), (1, 5), (1, 11), (2, 12), (3, 13), (1, 14))] == [False, True, False, False, False, False]
    assert cache.evictions == 2


def test_stream_equals_batch(spark, tmp_path):
    schema = "cache long, key long, at double, seq long"
    rows = pd.DataFrame({"cache": [i % 2 for i in range(60)], "key": [i * 7 % 11 for i in range(60)], "at": [float(i) for i in range(60)], "seq": range(60)})
    for part in range(3):
        rows.iloc[part * 20 : part * 20 + 20].to_json(tmp_path / f"{part}.json", orient="records", lines=True)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path))
    query = lru.stream(stream, 4).writeStream.outputMode("update").format("memory").queryName("lru_out").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.sql("SELECT cache, max(hits) AS hits, max(misses) AS misses FROM lru_out GROUP BY cache").collect()
    want = lru.replay(spark.createDataFrame(rows, schema), 4).collect()
    assert sorted((r["cache"], r["hits"], r["misses"]) for r in got) == sorted((r["cache"], r["hits"], r["misses"]) for r in want)
