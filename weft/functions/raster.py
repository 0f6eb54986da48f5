"""Small raster computations as expressions: sampled functions of several inputs, shading, masks, scaling, compositing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.color import div255
from weft.functions.numeric import clamp, map_range


def sampled_nd(inputs: Sequence[Column], sizes: Sequence[int], samples: Sequence[float], domains: Sequence[tuple[float, float]], outputs: int = 1, interpolate: bool = True) -> list[Column]:
    """Multilinear interpolation in a table whose first input varies fastest."""
    total = outputs
    for s in sizes:
        total *= s
    if len(samples) < total:
        raise ValueError(f"{total} samples are needed, {len(samples)} given")
    table = F.array(*[F.lit(float(s)) for s in samples])
    axes = []
    for x, size, domain in zip(inputs, sizes, domains):
        at = clamp(map_range(clamp(x, *domain), *domain, 0.0, size - 1.0), 0.0, size - 1.0)
        low = F.floor(at).cast("int")
        axes.append((low, F.least(low + 1, F.lit(size - 1)), at - low if interpolate else F.lit(0.0)))
    out = []
    for channel in range(outputs):
        value = F.lit(0.0)
        for corner in range(1 << len(sizes)):
            weight, index, stride = F.lit(1.0), F.lit(0), 1
            for d, (low, high, part) in enumerate(axes):
                up = corner >> d & 1
                weight = weight * (part if up else 1 - part)
                index = index + (high if up else low) * stride
                stride *= sizes[d]
            value = value + weight * F.element_at(table, (index * outputs + channel + 1).cast("int"))
        out.append(value)
    return out


def axial_parameter(x: Column, y: Column, start: tuple[float, float], end: tuple[float, float], extend: tuple[bool, bool] = (False, False)) -> Column:
    """Place of a point along an axis, 0 to 1; null outside, unless that end extends."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    t = ((x - start[0]) * dx + (y - start[1]) * dy) / (dx * dx + dy * dy)
    return F.when(t < 0, F.lit(0.0) if extend[0] else F.lit(None)).when(t > 1, F.lit(1.0) if extend[1] else F.lit(None)).otherwise(t)


def radial_parameter(x: Column, y: Column, c0: tuple[float, float, float], c1: tuple[float, float, float]) -> Column:
    """The largest t in 0..1 whose circle between two circles (x, y, r) passes through the point and has no negative radius."""
    dx, dy, dr = c1[0] - c0[0], c1[1] - c0[1], c1[2] - c0[2]
    a = dx * dx + dy * dy - dr * dr
    b = (x - c0[0]) * dx + (y - c0[1]) * dy + c0[2] * dr
    c = (x - c0[0]) ** 2 + (y - c0[1]) ** 2 - c0[2] ** 2
    good = lambda t: F.when((t >= 0) & (t <= 1) & (t * dr + c0[2] >= 0), t)
    if a == 0:
        return good(F.try_divide(c, b * 2))
    root = F.when(b * b - c * a >= 0, F.sqrt(F.abs(b * b - c * a)))
    return F.greatest(good((b + root) / a), good((b - root) / a))


def grid(spark, width: int, height: int) -> DataFrame:
    """(x, y) of every pixel."""
    return spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))


def shrink(pixels: DataFrame, factor: int, channels: Sequence[str]) -> DataFrame:
    """Box average of ``factor`` by ``factor`` tiles."""
    return pixels.groupBy(F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y")).agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in channels])


def apply_mask(pixels: DataFrame, mask: DataFrame, size: tuple[int, int], mask_size: tuple[int, int]) -> DataFrame:
    """``mask`` (mx, my, alpha) sampled at the nearest place; pixels without a mask entry are opaque."""
    at = pixels.withColumn("_mx", F.floor(F.col("x") * mask_size[0] / size[0]).cast("long")).withColumn("_my", F.floor(F.col("y") * mask_size[1] / size[1]).cast("long"))
    joined = at.join(mask, (F.col("_mx") == F.col("mx")) & (F.col("_my") == F.col("my")), "left")
    return joined.withColumn("alpha", F.coalesce("alpha", F.lit(255))).drop("_mx", "_my", "mx", "my")


def composite_stack(layers: Column, backdrop: Column) -> Column:
    """Fold of array<struct<v, alpha>> layers, bottom first, over one backdrop channel."""
    return F.aggregate(layers, backdrop.cast("int"), lambda below, top: div255(top["v"] * top["alpha"] + below * (255 - top["alpha"])).cast("int"))


def soft_mask(alpha: Column, luminosity: Column) -> Column:
    """Alpha of a pixel under a group's luminosity, bytes."""
    return div255(alpha * luminosity).cast("int")


def triangle(x: Column, y: Column, corners: Sequence[tuple[float, float]], colors: Sequence[Sequence[float]]) -> list[Column]:
    """Gouraud shading: corner colours mixed by the areas that the point cuts off; null outside the triangle."""
    (x0, y0), (x1, y1), (x2, y2) = corners
    area = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
    if area == 0:
        return [F.lit(None).cast("double") for _ in colors[0]]
    b = ((x - x0) * (y2 - y0) - (y - y0) * (x2 - x0)) / area
    c = ((y - y0) * (x1 - x0) - (x - x0) * (y1 - y0)) / area
    inside = (b >= 0) & (c >= 0) & (b + c <= 1)
    return [F.when(inside, p + b * (q - p) + c * (r - p)) for p, q, r in zip(*colors)]


def enlarge(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int], channels: Sequence[str]) -> DataFrame:
    """Bilinear scaling up of (x, y, channels).

    A pixel goes to the target pixels whose place, scaled back, lies less than one pixel away, with the product of what is left of the distances as weight; the last row and column reach to the edge.
    """

    def places(at: str, n: int, m: int) -> Column:
        step = n / m
        lo, hi = F.greatest(F.ceil((F.col(at) - 1) / step), F.lit(0)), F.least(F.floor((F.col(at) + 1) / step), F.lit(m - 1))
        weight = lambda t: F.greatest(F.lit(0.0), F.when((F.col(at) == n - 1) & (t * step > n - 1), 1.0).otherwise(1.0 - F.abs(t * step - F.col(at))))
        return F.filter(F.transform(F.sequence(lo, hi), lambda t: F.struct(t.alias("t"), weight(t).alias("w"))), lambda s: s["w"] > 0)

    rows = pixels.withColumn("_x", F.explode(places("x", size[0], target[0]))).withColumn("_y", F.explode(places("y", size[1], target[1])))
    weight = F.col("_x.w") * F.col("_y.w")
    return rows.groupBy(F.col("_x.t").alias("x"), F.col("_y.t").alias("y")).agg(*[F.floor(F.sum(F.col(c) * weight) + 1e-9).cast("int").alias(c) for c in channels])
