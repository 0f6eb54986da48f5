"""Two-pass external shuffle into shards [native: DataFrame functions only].

Pass one scatters every record to a bucket by seeded hashes: the shard by
highest-random-weight hashing of the key (the key and the shard count decide, and
one more shard takes records only into itself), then a sub-bucket, by a hash of the
whole record, small enough for one task's memory.  Pass two gathers each bucket, brings it into key order,
so that a retried task starts from the same array, and runs Fisher-Yates on it
(Spark's ``shuffle``).  A record's slot is its bucket's offset in the shard plus
its place in the shuffled bucket.

The number of buckets of a shard follows its bytes, so a bucket's size does not
grow with the corpus.  A key with many records fills its shard, as the law asks, but
many buckets of it; records that are equal in all columns more than ``EQUAL`` times
are counted, and dealt over the buckets by their number.

Defined cases: null text counts as no bytes; null keys hash like any one value;
equal rows keep one slot each, in either order; an empty table gives no rows;
map columns are carried as their entries; columns that clash with the added ones are
replaced by the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.stages import small, stage

BUCKET_BYTES = 8 << 20
EQUAL = 1000
SEED = 20_251


def _weight(key: Column, shard: int, seed: int) -> Column:
    return F.struct(F.xxhash64(key, F.lit(shard), F.lit(seed)).alias("h"), F.lit(shard).alias("s"))


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Shard by highest random weight: going to ``shards + 1`` moves keys only into the new shard."""
    if shards == 1:
        return F.lit(0)
    return F.greatest(*[_weight(key, s, seed) for s in range(shards)])["s"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _orderable(kind: T.DataType, column: Column) -> Column:
    return F.array_sort(F.map_entries(column)) if isinstance(kind, T.MapType) else column


def _restored(kind: T.DataType, column: Column) -> Column:
    return F.map_from_entries(column) if isinstance(kind, T.MapType) else column


def external_shuffle(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` int and ``slot`` long (gapless from 0 in each shard)."""
    kinds = {c: docs.schema[c].dataType for c in docs.columns if c not in ("shard", "slot")}
    columns = list(kinds)
    values = [_orderable(kind, F.col(f"`{c}`")) for c, kind in kinds.items()]
    row_id = [F.xxhash64(F.lit(salt), *[x for v in values for x in (v.isNull(), v)]) for salt in (1, 2)]
    rows = docs.select(
        F.col(key).alias("_key"), shard_of(F.col(key), shards, seed).alias("shard"), size_of(F.col(text)).alias("_size"), row_id[0].alias("_h1"), row_id[1].alias("_h2"), F.struct(*[v.alias(f"_{i}") for i, v in enumerate(values)]).alias("_row")
    )
    # buckets follow the bytes of their shard, so a shard with a hot key has more of them
    sizes = {r["shard"]: r["b"] for r in rows.groupBy("shard").agg(F.sum("_size").alias("b")).collect()}  # one row a shard
    subs = [int(max(1, -(-sizes.get(s, 0) // bucket_bytes))) for s in range(shards)]
    sub = lambda turn: F.pmod(F.xxhash64(F.lit(seed + 1), "_h1", "_h2", turn), F.element_at(F.array(*map(F.lit, subs)), F.col("shard") + 1)).cast("int")
    # rows that are equal very often are dealt by number, one by one
    often = stage(rows.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > EQUAL).select(F.col("_h1").alias("_o1"), F.col("_h2").alias("_o2"), "_n"), "shuffle-often")
    single = rows.withColumn("_sub", sub(F.lit(0)))
    if often.limit(1).count():
        same = (F.col("_h1") == F.col("_o1")) & (F.col("_h2") == F.col("_o2"))
        one = rows.join(small(often), same).groupBy("_h1", "_h2", "_n").agg(F.first("shard").alias("shard"), F.first("_key").alias("_key"), F.first("_row").alias("_row"))
        many = one.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).withColumn("_sub", sub(F.col("_turn")))
        wanted = ["shard", "_sub", "_key", "_h1", "_h2", "_row"]
        single = single.join(small(often), same, "left_anti").select(*wanted).unionByName(many.select(*wanted))
    counted = single.groupBy("shard", "_sub").count()
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = counted.select("shard", "_sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    # Spark's shuffle draws from a generator seeded by the partition's number: the number of partitions is
    # fixed here, and buckets stand in order, so retries and reruns draw the same permutations
    buckets = (
        single.select("shard", "_sub", F.struct("_key", "_h1", "_h2", "_row").alias("_row"))
        .repartition(sum(subs), "shard", "_sub")
        .groupBy("shard", "_sub")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
        .sortWithinPartitions("shard", "_sub")
        .select("shard", "_sub", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
        .join(offsets, ["shard", "_sub"])
    )
    out = buckets.select("shard", "_from", F.posexplode("_rows").alias("_at", "_row"))
    return out.select(*[_restored(kinds[c], F.col(f"_row._row._{i}")).alias(c) for i, c in enumerate(columns)], "shard", (F.col("_from") + F.col("_at")).alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard, records in slot order within each file."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
