"""Lines, paragraphs and runs from positioned items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_TOLERANCE = 3.0
SPACE_GAP = 1.5
PARAGRAPH_TENTHS = 16
DEFAULT_HEIGHT = 12.0


def islands(rows: DataFrame, partition: list[str], order: list[Column], breaks: Column, name: str) -> DataFrame:
    """Number the runs of rows: a run begins where ``breaks`` holds (it may look back with ``lag``)."""
    by = Window.partitionBy(*partition).orderBy(*order)
    flagged = rows.withColumn("_b", F.coalesce(breaks, F.lit(False)).cast("int"))
    return flagged.withColumn(name, F.sum("_b").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_b")


def paragraphs(lines: DataFrame, page: str, y: str, height: str, tie: str) -> DataFrame:
    """Lines from top to bottom with ``paragraph``: a gap above 1.6 times the height of the line before begins one.

    Sixteen tenths are rounded once, so the bound is the float nearest to the exact product; 1.6 as a float is not 1.6.
    """
    order = [F.desc(y), F.asc_nulls_last(tie)]
    by = Window.partitionBy(page).orderBy(*order)
    before = F.lag(y).over(by)
    tall = F.lag(F.when(F.col(height) > 0, F.col(height)).otherwise(DEFAULT_HEIGHT)).over(by)
    marked = lines.withColumn("_gap", before - F.col(y) > tall * PARAGRAPH_TENTHS / 10)
    return islands(marked, [page], order, F.col("_gap"), "paragraph").drop("_gap")


def diff_runs(rows: DataFrame, row: str, x: str, reach: int = 5, distinct: bool = False) -> DataFrame:
    """Runs of positions in a row: a new one begins more than ``reach`` after the last position; ``distinct`` counts equal positions once.

    One shuffle by row and one sort: of each run only its first and last rows are kept, and nothing is hashed, so a
    task holds what it sorts.  Positions without value come last, in the last run.
    """
    by = Window.partitionBy(row).orderBy(F.asc_nulls_last(x))
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    here, after = F.col(x), F.col("_next")
    place = (F.dense_rank() if distinct else F.row_number()).over(by).cast("bigint")
    around = rows.select(row, x).withColumns({"_first": F.row_number().over(by) == 1, "_last": F.lead(F.lit(1)).over(by).isNull(), "_prev": F.lag(x).over(by), "_next": F.lead(x).over(by), "_place": place})
    begins = F.col("_first") | F.coalesce(here > F.col("_prev") + reach, F.lit(False))
    ends = F.col("_last") | F.coalesce(after > here + reach, F.lit(False))
    edges = around.select(row, x, "_place", begins.alias("_begins"), ends.alias("_ends"), after.isNull().alias("_before_null")).where("_begins or _ends or _before_null")
    of_run = lambda c: F.last(F.when(F.col("_begins"), c), ignorenulls=True).over(so_far)
    runs = edges.select(
        row, (F.sum(F.col("_begins").cast("int")).over(so_far) - 1).cast("int").alias("run"), of_run(here).alias("x0"), F.last(here, ignorenulls=True).over(so_far).alias("x1"), (F.col("_place") - of_run(F.col("_place")) + 1).alias("n"), "_ends"
    )
    return runs.where("_ends").drop("_ends")


def _lines(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy clustering of one page: each item, top down, joins the nearest line within reach; a line's y is the mean of its items."""
    pdf = pdf.sort_values(["y", "x", "seq"], ascending=[False, True, True], kind="stable")
    means: list[float] = []
    members: list[list[tuple]] = []
    for y, x, width, text in zip(pdf["y"], pdf["x"], pdf["width"], pdf["text"]):
        gaps = [abs(y - m) for m in means]
        best = min(range(len(gaps)), key=gaps.__getitem__) if gaps else -1
        if best < 0 or gaps[best] > LINE_TOLERANCE:
            means.append(float(y))
            members.append([(x, text, width)])
        else:
            members[best].append((x, text, width))
            n = len(members[best])
            means[best] = (means[best] * (n - 1) + y) / n
    rows = []
    for mean, items in zip(means, members):
        items.sort(key=lambda i: (i[0], i[1]))
        body, right = items[0][1], items[0][0] + items[0][2]
        for x, text, width in items[1:]:
            body += (" " if x - right > SPACE_GAP and not body.endswith(" ") else "") + text
            right = x + width
        rows.append((mean, " ".join(body.split()), len(items)))
    rows.sort(key=lambda r: (-r[0], r[1]))
    return pd.DataFrame({"page": pdf["page"].iloc[0], "line": range(len(rows)), "y": [r[0] for r in rows], "text": [r[1] for r in rows], "items": [r[2] for r in rows]})


def text_lines(items: DataFrame) -> DataFrame:
    """``items`` (page, seq, x, y, width, text) -> (page, line, y, text, items).

    The clustering depends on the order of the items of a page, so it runs in
    Python, one page at a time; a page is a bounded group.
    """
    cleaned = items.select("page", "seq", F.col("x").cast("double"), F.col("y").cast("double"), F.col("width").cast("double"), "text").where(F.trim("text") != "")
    return cleaned.groupBy("page").applyInPandas(_lines, "page long, line int, y double, text string, items int")
