"""Pixel comparison over (x, y, channels) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.numeric import percent


def metrics(pixels: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """Exact and similarity percentages; similarity is out of 255 a channel and never below 0."""
    same = None
    delta = None
    for x, y in zip(a, b):
        eq, d = F.col(x) == F.col(y), F.abs(F.col(x) - F.col(y))
        same = eq if same is None else same & eq
        delta = d if delta is None else delta + d
    sums = pixels.agg(F.count(F.lit(1)).alias("total"), F.count_if(same).alias("matched"), F.coalesce(F.sum(delta), F.lit(0)).alias("abs_delta"))
    top = 255.0 * len(a)
    return sums.withColumn("exact_percent", percent(F.col("matched"), F.col("total"))).withColumn("similarity_percent", F.greatest(F.lit(0.0), 100.0 - percent(F.col("abs_delta"), F.col("total") * top)))


def compare_images(left: DataFrame, right: DataFrame, channels: Sequence[str], white: int | None = None) -> DataFrame:
    """Metrics of two images of (x, y, channels), whatever their sizes.

    A pixel that one image lacks is a mismatch over the larger area, or, with ``white``, a pixel of that value.
    """
    a = left.select("x", "y", F.lit(True).alias("_in_a"), *[F.col(c).alias(f"{c}_a") for c in channels])
    b = right.select("x", "y", F.lit(True).alias("_in_b"), *[F.col(c).alias(f"{c}_b") for c in channels])
    both = a.join(b, ["x", "y"], "full_outer")
    if white is not None:
        return metrics(both.na.fill(white, [f"{c}_{s}" for c in channels for s in "ab"]), [f"{c}_a" for c in channels], [f"{c}_b" for c in channels])
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    for c in channels:
        same = same & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    area = F.greatest(F.max(F.when(F.col("_in_a"), F.col("x"))), F.max(F.when(F.col("_in_b"), F.col("x")))) + 1, F.greatest(F.max(F.when(F.col("_in_a"), F.col("y"))), F.max(F.when(F.col("_in_b"), F.col("y")))) + 1
    sums = both.agg(F.count_if(same).alias("matched"), (area[0].cast("bigint") * area[1]).alias("total"))
    return sums.select("total", "matched", percent(F.col("matched"), F.col("total")).alias("exact_percent"))


def amplified_xor(a: Column, b: Column) -> Column:
    """Brightness of a differing channel: 64 and up; 0 for equal ones."""
    v = a.bitwiseXOR(b)
    return F.when(v == 0, 0).otherwise(64 + F.floor(v * 191 / 255).cast("int"))


def bounding_box(pixels: DataFrame, differs: Column) -> DataFrame:
    return pixels.where(differs).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))


def tiles(pixels: DataFrame, differs: Column, side: int = 48) -> DataFrame:
    return pixels.where(differs).groupBy(F.floor(F.col("x") / side).alias("tile_x"), F.floor(F.col("y") / side).alias("tile_y")).agg(F.count(F.lit(1)).alias("n"))


def tile_components(found: DataFrame, turns: int = 64) -> DataFrame:
    """Label of each tile: the least (y, x) of its 8-neighbour component, by label propagation until nothing changes."""
    labels = found.select("tile_x", "tile_y", F.struct("tile_y", "tile_x").alias("label"))
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    for _ in range(turns):
        sent = labels.select(F.explode(near).alias("d"), "tile_x", "tile_y", "label").select((F.col("tile_x") + F.col("d.dx")).alias("tile_x"), (F.col("tile_y") + F.col("d.dy")).alias("tile_y"), F.col("label").alias("other"))
        heard = sent.groupBy("tile_x", "tile_y").agg(F.min("other").alias("least"))
        new = labels.join(heard, ["tile_x", "tile_y"]).select("tile_x", "tile_y", "label", "least").checkpoint()
        if not new.where("least < label").limit(1).count():
            break
        labels = new.select("tile_x", "tile_y", F.col("least").alias("label"))
    return labels.select("tile_x", "tile_y", F.col("label.tile_x").alias("root_x"), F.col("label.tile_y").alias("root_y"))


def color_histogram(pixels: DataFrame, r: str, g: str, b: str, top: int = 10) -> DataFrame:
    """Commonest colours; equal counts by colour."""
    return pixels.groupBy(r, g, b).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), r, g, b).limit(top)
