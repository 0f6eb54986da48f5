"""Queries over small raster computations; order lines stand for pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import codecs, raster
from weft.plans.registry import query
from weft.sources import files, read_table

_KEYS = "l_orderkey, l_linenumber"


def _line(spark, folder):
    return read_table(spark, folder, "lineitem")


@query(
    "fn_sampled_2d",
    f"""SELECT {_KEYS}, round((1 - u) * (1 - v) * t[lo * 2 + 1] + u * (1 - v) * t[lo * 2 + 2] + (1 - u) * v * t[least(lo + 1, 2) * 2 + 1] + u * v * t[least(lo + 1, 2) * 2 + 2], 6) AS y
        FROM (SELECT *, CAST(floor(w) AS INTEGER) AS lo, w - floor(w) AS v, [0.0, 1.0, 2.0, 4.0, 3.0, 9.0] AS t
              FROM (SELECT {_KEYS}, greatest(0.0, least(1.0, l_discount * 10)) AS u, greatest(0.0, least(2.0, (l_quantity - 1) * 2 / 49)) AS w FROM lineitem))""",
)
def fn_sampled_2d(spark, folder):
    y = raster.sampled_nd([F.col("l_discount") * 10, F.col("l_quantity")], (2, 3), (0, 1, 2, 4, 3, 9), ((0.0, 1.0), (1.0, 50.0)))[0]
    return _line(spark, folder).select("l_orderkey", "l_linenumber", F.round(y, 6).alias("y"))


_T = "((x - 10) * 100 + (y - 5) * 50) / 12500.0"


@query("axial_shading", f"SELECT {_KEYS}, round(CASE WHEN {_T} < 0 THEN 0 WHEN {_T} > 1 THEN NULL ELSE {_T} END, 6) AS t FROM (SELECT *, l_partkey % 150 AS x, l_suppkey % 90 AS y FROM lineitem)")
def axial_shading(spark, folder):
    t = raster.axial_parameter(F.col("l_partkey") % 150, F.col("l_suppkey") % 90, (10.0, 5.0), (110.0, 55.0), (True, False))
    return _line(spark, folder).select("l_orderkey", "l_linenumber", F.round(t, 6).alias("t"))


@query("radial_shading", f"SELECT {_KEYS}, CASE WHEN sqrt(x * x + y * y) <= 120 THEN round(sqrt(x * x + y * y) / 120, 6) END AS t FROM (SELECT *, l_partkey % 150 AS x, l_suppkey % 90 AS y FROM lineitem)")
def radial_shading(spark, folder):
    t = raster.radial_parameter(F.col("l_partkey") % 150, F.col("l_suppkey") % 90, (0.0, 0.0, 0.0), (0.0, 0.0, 120.0))
    return _line(spark, folder).select("l_orderkey", "l_linenumber", F.round(t, 6).alias("t"))


@query("downscale", "SELECT CAST(l_partkey % 640 // 16 AS BIGINT) AS x, CAST(l_suppkey * 13 % 480 // 16 AS BIGINT) AS y, CAST(floor(avg(l_orderkey % 256)) AS INTEGER) AS v FROM lineitem GROUP BY 1, 2")
def downscale(spark, folder):
    pixels = _line(spark, folder).select((F.col("l_partkey") % 640).alias("x"), (F.col("l_suppkey") * 13 % 480).alias("y"), (F.col("l_orderkey") % 256).alias("v"))
    return raster.shrink(pixels, 16, ["v"])


@query(
    "alpha_mask",
    """SELECT p.id, CAST(coalesce(m.alpha, 255) AS INTEGER) AS alpha FROM (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey % 640 * 5 // 640 AS mx, l_suppkey * 13 % 480 * 5 // 480 AS my FROM lineitem) p
       LEFT JOIN (SELECT n_nationkey % 5 AS mx, n_nationkey // 5 AS my, n_nationkey * 10 AS alpha FROM nation WHERE n_nationkey % 6 <> 0) m ON p.mx = m.mx AND p.my = m.my""",
)
def alpha_mask(spark, folder):
    pixels = _line(spark, folder).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 640).alias("x"), (F.col("l_suppkey") * 13 % 480).alias("y"))
    mask = read_table(spark, folder, "nation").where("n_nationkey % 6 <> 0").select((F.col("n_nationkey") % 5).cast("long").alias("mx"), F.floor(F.col("n_nationkey") / 5).alias("my"), (F.col("n_nationkey") * 10).alias("alpha"))
    return raster.apply_mask(pixels, mask, (640, 480), (5, 5)).select("id", "alpha")


def _over(below: str, value: str, alpha: str) -> str:
    x = f"({value} * {alpha} + {below} * (255 - {alpha}))"
    return f"(({x} + ({x} >> 8) + 128) >> 8)"


@query(
    "group_composite",
    f"""SELECT l_orderkey, l_linenumber, CAST({_over("w", "c", "a")} AS INTEGER) AS v FROM (SELECT *, {_over("b", "a", "c")} AS w FROM
        (SELECT {_KEYS}, l_partkey * 37 % 256 AS a, l_suppkey * 91 % 256 AS b, l_orderkey % 256 AS c FROM lineitem))""",
)
def group_composite(spark, folder):
    a, b, c = ((F.col("l_partkey") * 37 % 256).cast("int"), (F.col("l_suppkey") * 91 % 256).cast("int"), (F.col("l_orderkey") % 256).cast("int"))
    layer = lambda v, alpha: F.struct(v.alias("v"), alpha.alias("alpha"))
    return _line(spark, folder).select("l_orderkey", "l_linenumber", raster.composite_stack(F.array(layer(a, c), layer(c, a)), b).alias("v"))


@query("signature_ranges", "SELECT p_partkey, p_partkey % 3 = 0 AS valid FROM part")
def signature_ranges(spark, folder):
    gap = F.when(F.col("p_partkey") % 3 == 1, 5).otherwise(20)
    end = F.when(F.col("p_partkey") % 3 == 2, 500).otherwise(20 + F.col("p_size"))
    ranges = F.array(F.lit(0), F.lit(10), gap, F.col("p_size"))
    return read_table(spark, folder, "part").select("p_partkey", files.signature_ranges_valid(ranges, end).alias("valid"))


@query("filter_chain", "SELECT doc_id, length(text) AS n, text = text AS same FROM documents")
def filter_chain(spark, folder):
    """Texts through hexadecimal digits and back."""
    docs = read_table(spark, folder, "documents")
    back = codecs.decode(F.encode(F.hex(F.encode("text", "UTF-8")), "UTF-8"), "ASCIIHexDecode").cast("string")
    return docs.select("doc_id", "text", back.alias("back")).select("doc_id", F.length("back").cast("bigint").alias("n"), (F.col("back") == F.col("text")).alias("same"))
