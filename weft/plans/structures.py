"""List edits, overlays, trees, rectangles, ranges and cache replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import lists
from weft.plans.registry import query
from weft.sources import read_table
from weft.streaming import lru


@query(
    "move_page",
    """SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 < c_custkey % 3 THEN list_concat(list_concat(k[1:(c_custkey % 3 - 1)], [p]), k[(c_custkey % 3):]) ELSE list_concat(list_concat(k[1:(c_custkey % 3)], [p]), k[(c_custkey % 3 + 1):]) END AS VARCHAR) AS pages
       FROM (SELECT c_custkey, (c_custkey % 5 + 1) * 10 AS p, list_filter([10, 20, 30, 40, 50], lambda x: x <> (c_custkey % 5 + 1) * 10) AS k FROM customer)""",
)
def move_page(spark, folder):
    pages = F.array(*[F.lit(x).cast("bigint") for x in (10, 20, 30, 40, 50)])
    moved = lists.move(pages, (F.col("c_custkey") % 5).cast("int"), (F.col("c_custkey") % 3).cast("int"))
    return read_table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("["), F.array_join(moved, ", "), F.lit("]")).alias("pages"))


@query(
    "overlay_merge",
    """SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN o.v ELSE c_mktsegment END AS value, o.k IS NOT NULL AS overridden
       FROM (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 9) c
       FULL JOIN (SELECT c_custkey AS k, concat('V', c_nationkey) AS v FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 10 = 9) o ON c.c_custkey = o.k
       WHERE coalesce(c_custkey, k) % 7 <> 0""".replace("SELECT c_custkey, CASE", "SELECT coalesce(c_custkey, k) AS c_custkey, CASE", 1),
)
def overlay_merge(spark, folder):
    customer = read_table(spark, folder, "customer")
    base = customer.where("c_custkey % 10 <> 9").select("c_custkey", F.col("c_mktsegment").alias("value"))
    over = customer.where("c_custkey % 4 = 0 OR c_custkey % 10 = 9").select("c_custkey", F.concat(F.lit("V"), F.col("c_nationkey").cast("string")).alias("value"))
    return lists.overlay(base, over, customer.where("c_custkey % 7 = 0"), "c_custkey", "value")


@query(
    "tree_flatten",
    """WITH RECURSIVE n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) // 3 END AS parent_id, n_name AS name FROM nation),
       t AS (SELECT id, 0 AS depth, name AS path FROM n WHERE parent_id IS NULL
             UNION ALL SELECT n.id, t.depth + 1, concat(t.path, '.', n.name) FROM t JOIN n ON n.parent_id = t.id)
       SELECT id, depth, path FROM t""",
)
def tree_flatten(spark, folder):
    nodes = read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 3).cast("int")).alias("parent_id"), F.col("n_name").alias("name"))
    return lists.flatten_tree(spark, nodes, F.col("parent_id").isNull())


_QUERIES = "(VALUES (0, 5, 100, 25, 200), (1, 30, 0, 31, 900), (2, 10, 10, 10, 50)) AS q(q, x0, y0, x1, y1)"


@query(
    "annotation_rect_overlap",
    f"""SELECT q, p_partkey FROM (SELECT p_partkey, p_size AS ax0, p_partkey AS ay0, p_size + 3 AS ax1, p_partkey + p_size % 4 AS ay1 FROM part), {_QUERIES}
        WHERE ax0 < x1 AND x0 < ax1 AND ay0 < y1 AND y0 < ay1 AND ax0 < ax1 AND ay0 < ay1 AND x0 < x1 AND y0 < y1""",
)
def annotation_rect_overlap(spark, folder):
    """Half-open rectangles; an empty one overlaps nothing.  The query rectangles are literals of one scan."""
    asked = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("q", "x0", "y0", "x1", "y1"), r)]) for r in ((0, 5, 100, 25, 200), (1, 30, 0, 31, 900), (2, 10, 10, 10, 50))])
    rects = read_table(spark, folder, "part").select("p_partkey", F.col("p_size").alias("ax0"), F.col("p_partkey").alias("ay0"), (F.col("p_size") + 3).alias("ax1"), (F.col("p_partkey") + F.col("p_size") % 4).alias("ay1"))
    pairs = rects.select("*", F.explode(asked).alias("r")).select("*", "r.*")
    return pairs.where("ax0 < x1 AND x0 < ax1 AND ay0 < y1 AND y0 < ay1 AND ax0 < ax1 AND ay0 < ay1 AND x0 < x1 AND y0 < y1").select("q", "p_partkey")


@query("unicode_ranges", "SELECT doc_id, CASE WHEN u <= 127 THEN 0 WHEN u <= 255 THEN 1 WHEN u <= 591 THEN 2 WHEN u BETWEEN 880 AND 1023 THEN 3 ELSE -1 END AS range FROM (SELECT doc_id, unicode(substr(text, 2, 1)) AS u FROM documents)")
def unicode_ranges(spark, folder):
    """The first range that holds a character; -1 if none does."""
    u = F.ascii(F.substring("text", 2, 1))
    found = None
    for i, (lo, hi) in reversed(list(enumerate(((0, 127), (128, 255), (256, 591), (880, 1023))))):
        found = F.when(u.between(lo, hi), i).otherwise(F.lit(-1) if found is None else found)
    return read_table(spark, folder, "documents").select("doc_id", found.alias("range"))


CAPACITY = 16


@query(
    "lru_hit_rate",
    f"""WITH a AS (SELECT user_id % 4 AS cache, user_id // 4 % 40 AS key, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS i FROM events),
             p AS (SELECT *, lag(i) OVER (PARTITION BY cache, key ORDER BY i) AS before FROM a),
             d AS (SELECT p.cache, p.i, p.before, count(DISTINCT b.key) AS between_keys FROM p LEFT JOIN a b ON p.cache = b.cache AND b.i > p.before AND b.i < p.i GROUP BY p.cache, p.i, p.before)
        SELECT cache, hits, misses, round(CASE WHEN hits + misses = 0 THEN 0 ELSE hits / (hits + misses) END, 6) AS rate FROM (
            SELECT CAST(cache AS BIGINT) AS cache, count(*) FILTER (before IS NOT NULL AND between_keys < {CAPACITY}) AS hits, count(*) FILTER (before IS NULL OR between_keys >= {CAPACITY}) AS misses FROM d GROUP BY cache)""",
)
def lru_hit_rate(spark, folder):
    events = read_table(spark, folder, "events")
    accesses = events.select((F.col("user_id") % 4).alias("cache"), (F.floor(F.col("user_id") / 4) % 40).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    out = lru.replay(accesses, CAPACITY)
    return out.select("cache", "hits", "misses", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 6).alias("rate"))
