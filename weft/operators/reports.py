"""Analytics over per-page compare reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.numeric import percent


def summarize(rows: DataFrame, document: str, exact: Column, error: Column, matched: Column, total: Column) -> DataFrame:
    """Documents, rows, exact and error rows, and the ratio of sums (0 for an empty report)."""
    ok = F.coalesce(exact & ~error, F.lit(False))
    sums = rows.agg(
        F.count_distinct(document).alias("documents"), F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("exact_pages"), F.count_if(error).alias("error_rows"), F.coalesce(F.sum(matched), F.lit(0)).alias("matched"), F.coalesce(F.sum(total), F.lit(0)).alias("total")
    )
    return sums.withColumn("percent", percent(F.col("matched"), F.col("total")))


def pass_rates(rows: DataFrame, by: list[str], passed: Column) -> DataFrame:
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.count_if(passed).alias("passed"))
    return n.withColumn("rate", percent(F.col("passed"), F.col("pages")))


def worst_per_document(rows: DataFrame, document: str, page: str, score: str, passed: Column, error: Column) -> DataFrame:
    """Mean, minimum, worst page (the first of equals) and all-pass of each document; error rows count only as failures."""
    good = F.when(~error, F.col(score))
    return rows.groupBy(document).agg(
        F.coalesce(F.avg(good), F.lit(0.0)).alias("mean"), F.min(good).alias("least"), F.min_by(page, F.when(~error, F.struct(score, page))).alias("worst_page"), F.count_if(error).alias("errors"), F.bool_and(passed & ~error).alias("all_pass")
    )


def count_by(rows: DataFrame, kind: Column, name: str) -> DataFrame:
    """Rows of each kind; a blank kind is ``unknown``."""
    return rows.groupBy(F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit("unknown")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def report_delta(before: DataFrame, after: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Both reports' metrics, their differences and whether any fell (one row)."""
    a = before.agg(*[F.coalesce(m, F.lit(0.0)).alias(f"{n}_before") for n, m in metrics.items()])
    b = after.agg(*[F.coalesce(m, F.lit(0.0)).alias(f"{n}_after") for n, m in metrics.items()])
    both = a.crossJoin(b)  # one row each
    for n in metrics:
        both = both.withColumn(f"{n}_delta", F.col(f"{n}_after") - F.col(f"{n}_before"))
    fell = F.lit(False)
    for n in metrics:
        fell = fell | (F.col(f"{n}_delta") < 0)
    return both.withColumn("regression", fell)


def page_spine(left: DataFrame, right: DataFrame, document: str, page: str) -> DataFrame:
    """Every page 1 .. last of either side, with what each side has there; a document without pages gets page 0."""
    l, r = left.select(document, page).distinct(), right.select(document, page).distinct()
    last = l.unionByName(r).groupBy(document).agg(F.max(page).alias("_last"))
    spine = last.select(document, F.explode(F.when(F.col("_last") >= 1, F.sequence(F.lit(1).cast("long"), F.col("_last").cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias(page))
    joined = spine.join(l.withColumn("has_left", F.lit(True)), [document, page], "left").join(r.withColumn("has_right", F.lit(True)), [document, page], "left")
    status = F.when(F.col("has_left").isNull() & F.col("has_right").isNull(), "both missing").when(F.col("has_left").isNull(), "left missing").when(F.col("has_right").isNull(), "right missing").otherwise("ok")
    return joined.select(document, page, status.alias("status"))


def markdown_summary(rows: DataFrame, threshold: float, is_page: Column, passed: Column, error: Column) -> DataFrame:
    """One row: the counts of a report as a Markdown list."""
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_page).alias("pages"), F.count_if(is_page & passed).alias("passed"), F.count_if(error).alias("errors"))
    line = lambda name, c: F.concat(F.lit(f"- {name}: `"), F.col(c).cast("string"), F.lit("`"))
    return n.select(F.concat_ws("\n", F.lit("# Summary"), F.lit(""), F.lit(f"- Threshold: `{threshold:.2f}%`"), line("Total rows", "all"), line("Page rows", "pages"), line("Pass pages", "passed"), line("Error rows", "errors")).alias("summary"))
