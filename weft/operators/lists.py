"""Ordered-list edits, overlays and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_at(pages: Column, at: Column, page: Column) -> Column:
    """Insert before the 0-based place; the place is clamped to the list."""
    n = F.size(pages)
    i = F.greatest(F.lit(0), F.least(at, n))
    return F.concat(F.slice(pages, F.lit(1), i), F.array(page), F.slice(pages, i + 1, n))


def remove_at(pages: Column, at: Column) -> Column:
    return F.concat(F.slice(pages, F.lit(1), at), F.slice(pages, at + 2, F.size(pages)))


def move(pages: Column, source: Column, target: Column) -> Column:
    """Remove, then insert; a target behind the source counts in the list before removal, so i to i + 1 changes nothing."""
    page = F.get(pages, source)
    return insert_at(remove_at(pages, source), F.when(target > source, target - 1).otherwise(target), page)


def overlay(base: DataFrame, overrides: DataFrame, deleted: DataFrame, key: str, value: str) -> DataFrame:
    """Copy-on-write view: an override wins, new keys appear, deleted keys are hidden."""
    over = overrides.select(F.col(key), F.col(value).alias("_over"))
    merged = base.select(key, value).join(over, key, "full_outer").select(key, F.coalesce("_over", value).alias(value), F.col("_over").isNotNull().alias("overridden"))
    return merged.join(deleted.select(key), key, "left_anti")


def flatten_tree(spark, nodes: DataFrame, root: Column, most_depth: int = 32) -> DataFrame:
    """``nodes`` (id, parent_id, name) -> (id, depth, path) in SQL recursion, with a guard against cycles and a depth cap."""
    nodes.createOrReplaceTempView("_weft_nodes")
    nodes.where(root).createOrReplaceTempView("_weft_roots")
    return spark.sql(f"""
        WITH RECURSIVE tree (id, depth, path, seen) AS (
            SELECT id, 0, CAST(name AS STRING), array(id) FROM _weft_roots
            UNION ALL
            SELECT n.id, t.depth + 1, concat(t.path, '.', n.name), array_append(t.seen, n.id)
            FROM tree t JOIN _weft_nodes n ON n.parent_id = t.id
            WHERE t.depth < {int(most_depth)} AND NOT array_contains(t.seen, n.id)
        )
        SELECT id, depth, path FROM tree""")
