"""Page lists and page output: merging, importing, trees of pages and fields, blocks of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_documents(parts: DataFrame, job: str, order: str, count: str) -> DataFrame:
    """``parts`` (job, order, number of pages) -> one row a page: job, page from 0 in the merged document, order, source page.

    Only the parts are numbered in a window; their pages follow from a sequence.
    """
    before = Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select(job, order, F.col(count).alias("_n"), F.coalesce(F.sum(count).over(before), F.lit(0)).alias("_from"))
    pages = offset.where("_n > 0").select(job, order, "_from", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("_n") - 1).cast("bigint"))).alias("source_page"))
    return pages.select(job, (F.col("_from") + F.col("source_page")).cast("bigint").alias("page"), order, "source_page")


def import_after(pages: Column, other: Column, after: int, start: int = 1, end: int = 0) -> Column:
    """Pages start..end (from 1; 0 is the last one) of ``other`` behind page ``after`` of ``pages``.

    Bounds beyond the list are clamped, inverted ones swapped; a page that is not there means the last one.
    """
    n = F.size(other)
    first = F.greatest(F.lit(start), F.lit(1))
    last = F.when((F.lit(end) <= 0) | (F.lit(end) > n), n).otherwise(F.lit(end))
    lo, hi = F.least(first, last), F.least(F.greatest(first, last), n)
    at = F.when(F.lit(after).between(F.lit(1), F.size(pages)), F.lit(after)).otherwise(F.size(pages))
    part = F.when((hi >= lo) & (lo >= 1), F.slice(other, lo, hi - lo + 1)).otherwise(F.slice(other, F.lit(1), F.lit(0)))
    return F.concat(F.slice(pages, F.lit(1), at), part, F.slice(pages, at + 1, F.size(pages)))


def page_leaves(spark, nodes: DataFrame, most_depth: int = 32) -> DataFrame:
    """``nodes`` (root, id, parent_id, pos, is_page) -> (root, page, id): pages in the order of the tree, from 0.

    A node's key is its places from the root down; cycles end at ``most_depth``.
    """
    nodes.createOrReplaceTempView("_weft_page_nodes")
    tree = spark.sql(f"""
        WITH RECURSIVE walk (root, id, is_page, key, depth) AS (
            SELECT root, id, is_page, array(pos), 0 FROM _weft_page_nodes WHERE parent_id IS NULL
            UNION ALL
            SELECT w.root, n.id, n.is_page, array_append(w.key, n.pos), w.depth + 1
            FROM walk w JOIN _weft_page_nodes n ON n.root = w.root AND n.parent_id = w.id
            WHERE NOT w.is_page AND w.depth < {int(most_depth)}
        )
        SELECT root, id, key FROM walk WHERE is_page""")
    return tree.select("root", (F.row_number().over(Window.partitionBy("root").orderBy("key")) - 1).alias("page"), "id")


def terminal_fields(fields: DataFrame, key: str, parent: str, own: Column) -> DataFrame:
    """Fields without children, and those with children that carry a type or value of their own."""
    parents = fields.select(F.col(parent).alias("_p")).where("_p is not null").distinct()
    return fields.join(parents, F.col(key) == F.col("_p"), "left").where(F.col("_p").isNull() | own).drop("_p")


def page_output(items: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, text): the pages of a document, each behind a line with its number; a document is a bounded group."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.concat(F.lit("--- Page "), F.col(page).cast("string"), F.lit(" ---\n"), F.col(text), F.lit("\n")).alias("t"))))
    return items.groupBy(document).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n").alias("text"))


def positioned(x: Column, y: Column, text: Column) -> Column:
    return F.format_string("[%.2f,%.2f] %s", x.cast("double"), y.cast("double"), text)


def column_list(pages: DataFrame, page: str, text: str) -> DataFrame:
    """One column a page, that of its whole text."""
    return pages.select((F.col(page) + 1).alias("page"), F.lit(0).alias("flow"), F.lit(0).alias("column"), F.coalesce(F.col(text), F.lit("")).alias("styled"))


def image_blocks(pages: DataFrame, images: Column, box: Column) -> DataFrame:
    """A block for each image of a page; it is the page's box."""
    return pages.where(images > 0).select("*", F.explode(F.sequence(F.lit(1), images)).alias("image"), box.alias("block"))


def highlight(spans: DataFrame, page: str, text: str, start: int, end: int) -> DataFrame:
    """(page, match, x0, y0, x1, y1) of the characters [start, end) of each page.

    ``spans`` are a page's items with span_start, span_end and boxes.  Inverted bounds are swapped, an empty range is
    one character, bounds are clamped to the text, and pages that end before it have no row.
    """
    lo, hi = min(start, end), max(start, end)
    lo, hi = max(lo, 0), hi + (lo == hi)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_start", text))), lambda s: s[text]), "")
    hit = (F.col("span_end") > lo) & (F.col("span_start") < hi)
    edges = [f(F.when(hit, F.col(c))).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return spans.groupBy(page).agg(F.substring(whole, lo + 1, hi - lo).alias("match"), *edges).where("match <> '' and x0 is not null")


def quads(points: Column) -> Column:
    """Envelopes [x0, y0, x1, y1] of quadrangles (eight numbers each) or, if they are no multiple of eight, of point pairs (four); null if neither."""
    n = F.size(points)
    width = F.when(n % 8 == 0, 8).when(n % 4 == 0, 4)

    def envelope(i: Column) -> Column:
        part = F.slice(points, i * width + 1, width)
        even = lambda keep: F.filter(part, lambda _, j: j % 2 == keep)
        return F.array(F.array_min(even(0)), F.array_min(even(1)), F.array_max(even(0)), F.array_max(even(1)))

    return F.when(n >= 4, F.transform(F.sequence(F.lit(0), F.floor(n / width).cast("int") - 1), envelope))
