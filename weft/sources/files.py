"""Folder scans and session state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SKIPPED = ("bin", "build", "tmp")
SESSION = "page_order array<int>, removed array<int>, labels map<string,string>, fields map<string,string>"


def scan_documents(spark: SparkSession, *roots: str, suffix: str = ".pdf") -> DataFrame:
    """(slug, path, length) of all files with the suffix, any case, below the roots.

    Hidden folders and build folders are left out, a path counts once, and slugs
    are a dense index in path order and the file's name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots)).select("path", "length")
    parts = F.split("path", "/")
    inner = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(inner, lambda p: (p.startswith(".") & (F.length(p) > 1)) | p.isin(*SKIPPED)) if not any(f"/{s}/" in f"{r}/" for r in roots for s in SKIPPED) else F.exists(inner, lambda p: p.startswith(".") & (F.length(p) > 1))
    kept = files.where(F.lower("path").endswith(suffix) & ~hidden).dropDuplicates(["path"])
    name = F.regexp_replace(F.regexp_replace(F.lower(F.element_at(parts, -1)), r"\.[a-z]+$", ""), r"[^a-z0-9]+", "-")
    return kept.select(F.format_string("%03d-%s", F.row_number().over(Window.orderBy("path")), name).alias("slug"), "path", "length")  # one row a file


def session_from_json(text: Column) -> Column:
    return F.from_json(text, SESSION)


def session_to_json(state: Column) -> Column:
    return F.to_json(state)


def signature_ranges_valid(ranges: Column, length: Column) -> Column:
    """Structural check of [a, n, b, m]: from the start, in order, without overlap, to the end of the file."""
    a, n, b, m = (F.get(ranges, F.lit(i)) for i in range(4))
    return F.coalesce((F.size(ranges) == 4) & (a == 0) & (n > 0) & (b >= a + n) & (m >= 0) & (b + m == length), F.lit(False))


def xfdf(fields: DataFrame, order: str, name: str = "name", value: str = "value") -> DataFrame:
    """One row with the form data of ``fields`` as XFDF text; the fields of one form are a bounded group."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    item = F.concat(F.lit('<field name="'), safe(name), F.lit('"><value>'), safe(value), F.lit("</value></field>"))
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))), lambda s: s["x"])
    return fields.agg(F.concat(F.lit("<xfdf><fields>"), F.array_join(items, ""), F.lit("</fields></xfdf>")).alias("xfdf"))
