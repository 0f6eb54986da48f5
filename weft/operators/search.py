"""Literal text search: overlapping matches, case and whole-word rules, limits and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from weft.functions.text import WORD_CHAR, context, fold, fold_literal, quoted
from weft.operators.terms import count_batches


def find_matches(pages: DataFrame, query: str, case_sensitive: bool = False, whole_word: bool = False, page_start: int = -1, page_end: int = -1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end): every match, by characters from 0, ends exclusive; matches may overlap.

    A text is split before each match, so a match starts where the lengths of the
    pieces before it add up to.  Texts without the term are filtered in the scan;
    only piece lengths, not texts, are shuffled to add them up.
    Page bounds below 0 mean the first and the last page.
    """
    query = query.strip()
    if not query:
        raise ValueError("empty search query")
    term = query if case_sensitive else fold_literal(query)
    body = F.col(text) if case_sensitive else fold(F.col(text))
    if page_start >= 0:
        pages = pages.where(F.col(key) >= page_start)
    if page_end >= 0:
        pages = pages.where(F.col(key) <= page_end)
    after = f"(?!{WORD_CHAR})" if whole_word else ""
    before = f"(?<!{WORD_CHAR})" if whole_word else ""
    at_start = body.rlike(f"^{quoted(term)}{after}")  # nothing can be split off before the first character
    # rows are told apart by their place in the scan, so rows that share a key keep their own offsets
    pieces = pages.where(body.contains(term)).withColumn("_row", F.monotonically_increasing_id()).select(key, "_row", at_start.alias("first"), F.posexplode(F.split(body, f"{before}(?={quoted(term)}{after})", -1)).alias("pos", "piece"))
    lengths = pieces.select(key, "_row", "pos", F.length("piece").alias("n"), ((F.col("pos") > 0) | F.col("first")).alias("hit"))
    so_far = Window.partitionBy(key, "_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = lengths.withColumn("start", F.coalesce(F.sum("n").over(so_far), F.lit(0)).cast("int"))
    return placed.where("hit").select(key, "start", (F.col("start") + len(term)).alias("end"))


def limit_matches(matches: DataFrame, per_page: int, total: int, key: str = "doc_id") -> DataFrame:
    """The first matches of each page, then the first of all, in page order."""
    by = Window.partitionBy(key).orderBy("start")
    return matches.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= per_page).drop("_r").orderBy(key, "start").limit(total)


def with_context(matches: DataFrame, pages: DataFrame, key: str = "doc_id", text: str = "text", query: str | None = None) -> DataFrame:
    """Matches with their text and its surroundings; given the ``query``, only the texts that hold it are joined.  Keys are of one page each."""
    if query is not None:
        pages = pages.where(fold(F.col(text)).contains(fold_literal(query.strip())))
    joined = matches.join(pages.select(key, text), key)
    return joined.select(key, "start", "end", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("match"), context(F.col(text), F.col("start"), F.col("end")).alias("context"))


def matches_by_page(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, matches): each page's matches as an array of (start, end), in their order."""
    return matches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("matches"))


def searched_pages(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of pages with a match, and of matches."""
    return matches.agg(F.count_distinct(key).alias("pages"), F.count(F.lit(1)).alias("matches"))


def group_by_page(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    return matches.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.max("start").alias("last_start"))


def count_occurrences(pages: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n) of pages with the term, case ignored, overlapping matches counted; nothing is shuffled."""
    term = fold_literal(query.strip())
    body = fold(F.col(text))
    pieces = F.split(body, f"(?={quoted(term)})", -1)
    n = F.size(pieces) - 1 + F.when(F.startswith(body, F.lit(term)), 1).otherwise(0)
    return pages.where(body.contains(term)).select(key, n.alias("n"))


def dictionary_search(pages: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term_id, n) for each term that a page holds.

    Equal terms are looked for once.  Pages are read and folded once, whatever the number of terms, and their bytes are
    walked through a tree of all terms in Arrow batches.
    """
    spelt: dict[str, list] = {}
    for r in terms.where("term is not null").select(F.col("term_id").cast("bigint"), "term").orderBy("term_id").toLocalIterator():
        spelt.setdefault(fold_literal(r["term"]), []).append(r["term_id"])
    if "" in spelt:
        raise ValueError("empty term")
    listed, ids = list(spelt), list(spelt.values())

    def count(batches):
        return count_batches(batches, listed, ids)

    folded = pages.where(F.col(text).isNotNull()).select(key, fold(F.col(text)).alias("_body"))
    fields = [folded.schema[key], StructField("term_id", LongType()), StructField("n", IntegerType())]
    return folded.mapInArrow(count, StructType(fields))


# --- items of a page and geometry ---


def item_spans(items: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """Each item's [span_start, span_end) in the concatenation of its page's items."""
    so_far = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(text)
    spans = items.where(F.col(text) != "").withColumn("span_start", F.coalesce(F.sum(n).over(so_far), F.lit(0)))
    return spans.withColumn("span_end", F.col("span_start") + n)


def page_texts(items: DataFrame, page: str, order: str, text: str, separator: str = "") -> DataFrame:
    """(page, text) of a page's items in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return items.groupBy(page).agg(F.array_join(ordered, separator).alias("text"))


def match_geometry(matches: DataFrame, spans: DataFrame, page: str, box: tuple[str, str, str, str]) -> DataFrame:
    """Envelope of the items that each match overlaps; zeros where there are none."""
    m, s = matches.alias("m"), spans.alias("s")
    joined = m.join(s, (F.col(f"m.{page}") == F.col(f"s.{page}")) & (F.col("s.span_end") > F.col("m.start")) & (F.col("s.span_start") < F.col("m.end")), "left")
    x0, y0, x1, y1 = box
    return joined.groupBy(F.col(f"m.{page}").alias(page), "m.start", "m.end").agg(
        F.coalesce(F.min(x0), F.lit(0)).alias("x0"), F.coalesce(F.min(y0), F.lit(0)).alias("y0"), F.coalesce(F.max(x1), F.lit(0)).alias("x1"), F.coalesce(F.max(y1), F.lit(0)).alias("y1"), F.count(F.col(f"s.{page}")).alias("items")
    )
