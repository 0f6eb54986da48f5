"""Queries over page texts: search, counting, normalisation, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import layout, search
from weft.plans.registry import query
from weft.sources import read_table, reports

TOP = 20


def _starts(term: str, body: str = "lower(text)", keep: str = "true") -> str:
    """DuckDB: every start of a term, by brute force over positions."""
    n = len(term)
    return f"""
        SELECT doc_id, text, CAST(i - 1 AS INTEGER) AS "start", CAST(i - 1 + {n} AS INTEGER) AS "end"
        FROM (SELECT doc_id, text, b, unnest(list_filter(range(1, length(b) + 1), lambda i: substr(b, i, {n}) = '{term}')) AS i
              FROM (SELECT doc_id, text, {body} AS b FROM documents WHERE contains({body}, '{term}')))
        WHERE {keep}"""


_BOUNDED = "NOT regexp_matches(substr(text, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[\\p{L}\\p{N}_]') AND NOT regexp_matches(substr(text, i + %d, 1), '[\\p{L}\\p{N}_]')"


@query(
    "search_count_topk",
    f"""SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4 AS INTEGER) AS n
        FROM documents WHERE contains(lower(text), 'tion') ORDER BY n DESC, doc_id LIMIT {TOP}""",
)
def search_count_topk(spark, folder):
    docs = read_table(spark, folder, "documents")
    return search.count_occurrences(docs, "tion").orderBy(F.desc("n"), "doc_id").limit(TOP)


@query("search_matches", f'SELECT doc_id, "start", "end" FROM ({_starts("nana")})')
def search_matches(spark, folder):
    return search.find_matches(read_table(spark, folder, "documents"), "nana")


@query("search_case_sensitive", f'SELECT doc_id, "start", "end" FROM ({_starts("Tion", "text")})')
def search_case_sensitive(spark, folder):
    return search.find_matches(read_table(spark, folder, "documents"), "Tion", case_sensitive=True)


@query("search_whole_word", f'SELECT doc_id, "start", "end" FROM ({_starts("oner", keep=_BOUNDED % 4)})')
def search_whole_word(spark, folder):
    return search.find_matches(read_table(spark, folder, "documents"), "Oner ", whole_word=True)


@query("search_page_range", f'SELECT doc_id, "start", "end" FROM ({_starts("ention")}) WHERE doc_id BETWEEN 10 AND 60')
def search_page_range(spark, folder):
    return search.find_matches(read_table(spark, folder, "documents"), "ention", page_start=10, page_end=60)


_SPACE = r"[\p{Z}\t\n\x{0B}\f\r\x{85}]+"


@query(
    "search_context",
    f"""SELECT doc_id, "start", "end", substr(text, "start" + 1, "end" - "start") AS "match",
               trim(regexp_replace(concat(CASE WHEN "start" > 20 THEN '...' ELSE '' END,
                    substr(text, greatest("start" - 20, 0) + 1, least("end" + 20, length(text)) - greatest("start" - 20, 0)),
                    CASE WHEN "end" + 20 < length(text) THEN '...' ELSE '' END), '{_SPACE}', ' ', 'g')) AS context
        FROM ({_starts("stupid")})""",
)
def search_context(spark, folder):
    docs = read_table(spark, folder, "documents")
    return search.with_context(search.find_matches(docs, "stupid"), docs, query="stupid")


@query(
    "search_limit_per_page_global",
    f"""SELECT doc_id, "start", "end" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS r FROM ({_starts("anti")}))
        WHERE r <= 2 ORDER BY doc_id, "start" LIMIT 50""",
)
def search_limit_per_page_global(spark, folder):
    return search.limit_matches(search.find_matches(read_table(spark, folder, "documents"), "anti"), 2, 50)


@query("search_group_by_page", f'SELECT doc_id, count(*) AS n, min("start") AS first_start, max("start") AS last_start FROM ({_starts("anti")}) GROUP BY doc_id')
def search_group_by_page(spark, folder):
    return search.group_by_page(search.find_matches(read_table(spark, folder, "documents"), "anti"))


@query(
    "dictionary_search",
    """WITH t AS (SELECT item_id AS term_id, lower(regexp_extract(text, '^[A-Za-z]+')) AS term FROM benchmark WHERE regexp_matches(text, '^[A-Za-z]{3,}'))
       SELECT doc_id, term_id, CAST(n AS INTEGER) AS n FROM (
           SELECT doc_id, term_id, len(list_filter(range(2, len(p) + 1), lambda k: starts_with(array_to_string(p[k:k + length(term)], chr(1)), replace(substr(term, 2), substr(term, 1, 1), chr(1))))) AS n
           FROM (SELECT doc_id, term_id, term, string_split(lower(text), substr(term, 1, 1)) AS p FROM documents, t WHERE contains(lower(text), term))) WHERE n > 0""",
)
def dictionary_search(spark, folder):
    terms = read_table(spark, folder, "benchmark").where(F.col("text").rlike("^[A-Za-z]{3,}")).select(F.col("item_id").alias("term_id"), F.regexp_extract("text", "^[A-Za-z]+", 0).alias("term"))
    return search.dictionary_search(read_table(spark, folder, "documents"), terms)


@query("word_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{Nd}_'']+')) AS INTEGER) AS words FROM documents")
def word_count(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("word_count_by_lang", r"SELECT lang, count(*) AS pages, CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{Nd}_'']+'))) AS BIGINT) AS words FROM documents GROUP BY lang")
def word_count_by_lang(spark, folder):
    return read_table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.sum(T.word_count(F.col("text"))).alias("words"))


@query("normalize_whitespace", f"SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS text FROM documents")
def normalize_whitespace(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query(
    "garbled_ratio",
    r"""SELECT doc_id, round(r, 6) AS ratio, coalesce(r < 0.8, true) AS garbled FROM (
        SELECT doc_id, CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[^\p{L}\p{M}\p{N}\p{P}\p{S} ]|\x{FFFD}', '', 'g')) / length(s) END AS r
        FROM (SELECT doc_id, trim(text) AS s FROM documents))""",
)
def garbled_ratio(spark, folder):
    text = F.col("text")
    return read_table(spark, folder, "documents").select("doc_id", F.round(T.printable_ratio(text), 6).alias("ratio"), T.is_garbled(text).alias("garbled"))


@query("text_range", "SELECT doc_id, substr(text, 6, 20) AS part FROM documents")
def text_range(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", T.text_range(F.col("text"), 5, 25).alias("part"))


@query("slug_one_line", r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace(html, '[\r\n]+', ' ', 'g')) AS line FROM pages")
def slug_one_line(spark, folder):
    return read_table(spark, folder, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"), T.one_line(F.col("html")).alias("line"))


# --- items in a page: conversations stand for lines in reading order ---


@query("text_concat_pages", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def text_concat_pages(spark, folder):
    return search.page_texts(read_table(spark, folder, "conversations"), "conv_id", "turn", "text", "\n")


_SPANS = """(SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span_start,
             length(text) AS n FROM conversations WHERE text <> '')"""


@query("item_spans", f"SELECT conv_id, turn, CAST(span_start AS BIGINT) AS span_start, CAST(span_start + n AS BIGINT) AS span_end FROM {_SPANS}")
def item_spans(spark, folder):
    spans = search.item_spans(read_table(spark, folder, "conversations"), "conv_id", "turn", "text")
    return spans.select("conv_id", "turn", F.col("span_start").cast("bigint"), F.col("span_end").cast("bigint"))


@query("caret_lookup", f"SELECT conv_id, turn, CAST(100 - span_start AS BIGINT) AS place FROM {_SPANS} WHERE span_start <= 100 AND 100 < span_start + n")
def caret_lookup(spark, folder):
    spans = search.item_spans(read_table(spark, folder, "conversations"), "conv_id", "turn", "text")
    return spans.where("span_start <= 100 AND 100 < span_end").select("conv_id", "turn", (100 - F.col("span_start")).cast("bigint").alias("place"))


@query(
    "match_geometry",
    f"""WITH m AS (SELECT conv_id, CAST(o AS INTEGER) AS "start", CAST(o + 60 AS INTEGER) AS "end" FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0), (150), (100000)) v(o)),
             s AS (SELECT *, turn * 20 AS y0, turn * 20 + 12 AS y1, 0 AS x0, n AS x1 FROM {_SPANS})
        SELECT m.conv_id, m."start", m."end", CAST(coalesce(min(x0), 0) AS BIGINT) AS x0, CAST(coalesce(min(y0), 0) AS BIGINT) AS y0, CAST(coalesce(max(x1), 0) AS BIGINT) AS x1, CAST(coalesce(max(y1), 0) AS BIGINT) AS y1, count(s.conv_id) AS items
        FROM m LEFT JOIN s ON m.conv_id = s.conv_id AND s.span_start + s.n > m."start" AND s.span_start < m."end" GROUP BY m.conv_id, m."start", m."end\"""",
)
def match_geometry(spark, folder):
    lines = read_table(spark, folder, "conversations")
    spans = search.item_spans(lines, "conv_id", "turn", "text").select("conv_id", "span_start", "span_end", F.lit(0).alias("x0"), (F.col("turn") * 20).alias("y0"), F.length("text").alias("x1"), (F.col("turn") * 20 + 12).alias("y1"))
    matches = lines.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(0), F.lit(150), F.lit(100000))).alias("start")).withColumn("end", F.col("start") + 60)
    out = search.match_geometry(matches, spans, "conv_id", ("x0", "y0", "x1", "y1"))
    return out.select("conv_id", "start", "end", *[F.col(c).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")], "items")


@query(
    "paragraph_breaks",
    """WITH l AS (SELECT user_id, event_id, value AS y, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 + event_id % 5 END AS height FROM events),
            g AS (SELECT *, lag(y) OVER w - y > 1.6 * lag(CASE WHEN height > 0 THEN height ELSE 12 END) OVER w AS b FROM l WINDOW w AS (PARTITION BY user_id ORDER BY y DESC, event_id))
       SELECT user_id, event_id, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY y DESC, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS paragraph FROM g""",
)
def paragraph_breaks(spark, folder):
    lines = read_table(spark, folder, "events").select("user_id", "event_id", F.col("value").alias("y"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(2 + F.col("event_id") % 5).alias("height"))
    return layout.paragraphs(lines, "user_id", "y", "height", "event_id").select("user_id", "event_id", "paragraph")


@query(
    "diff_runs",
    """WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
            g AS (SELECT *, l_partkey > lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) + 5 AS b FROM p),
            r AS (SELECT *, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_partkey ROWS UNBOUNDED PRECEDING) AS INTEGER) AS run FROM g)
       SELECT l_suppkey, run, min(l_partkey) AS x0, max(l_partkey) AS x1, count(*) AS n FROM r GROUP BY l_suppkey, run""",
)
def diff_runs(spark, folder):
    return layout.diff_runs(read_table(spark, folder, "lineitem"), "l_suppkey", "l_partkey", distinct=True)


@query(
    "text_lines",
    """WITH RECURSIVE i AS (
           SELECT page, row_number() OVER (PARTITION BY page ORDER BY y DESC, x, seq) AS k, x, y, text
           FROM (SELECT user_id AS page, event_id AS seq, CAST(event_id * 7 % 500 AS DOUBLE) AS x, CAST(value * 4 % 300 AS DOUBLE) AS y, event_type AS text FROM events WHERE trim(event_type) <> '')),
       s AS (
           SELECT page, k, [y] AS means, [1] AS ns, CAST(1 AS BIGINT) AS line FROM i WHERE k = 1
           UNION ALL
           SELECT page, k, CASE WHEN near THEN list_concat(list_concat(means[1:b - 1], [(means[b] * ns[b] + y) / (ns[b] + 1)]), means[b + 1:]) ELSE list_append(means, y) END,
                  CASE WHEN near THEN list_concat(list_concat(ns[1:b - 1], [ns[b] + 1]), ns[b + 1:]) ELSE list_append(ns, 1) END, CAST(CASE WHEN near THEN b ELSE len(means) + 1 END AS BIGINT)
           FROM (SELECT page, k, means, ns, y, list_position(gaps, list_min(gaps)) AS b, list_min(gaps) <= 3.0 AS near
                 FROM (SELECT s.page, i.k, means, ns, i.y, list_transform(means, lambda m: abs(i.y - m)) AS gaps FROM s JOIN i ON s.page = i.page AND i.k = s.k + 1))),
       ends AS (SELECT page, arg_max(means, k) AS means FROM s GROUP BY page),
       parts AS (SELECT s.page, s.line, x, text, CASE WHEN x - lag(x + 6) OVER (PARTITION BY s.page, s.line ORDER BY x, text) > 1.5 THEN ' ' ELSE '' END || text AS part FROM s JOIN i ON s.page = i.page AND s.k = i.k),
       lines AS (SELECT p.page, any_value(means[p.line]) AS y, string_agg(part, '' ORDER BY x, text) AS text, CAST(count(*) AS INTEGER) AS items FROM parts p JOIN ends ON p.page = ends.page GROUP BY p.page, p.line)
       SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y DESC, text) - 1 AS INTEGER) AS line, y, text, items FROM lines""",
)
def text_lines(spark, folder):
    """Greedy clustering depends on the order of items: pages run one by one, the SQL by recursion."""
    events = read_table(spark, folder, "events")
    return layout.text_lines(events.select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 500).alias("x"), (F.col("value") * 4 % 300).alias("y"), F.lit(6.0).alias("width"), F.col("event_type").alias("text")))


# --- markup ---


@query(
    "html_title_links",
    r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS INTEGER) AS links FROM pages""",
)
def html_title_links(spark, folder):
    return read_table(spark, folder, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("links"))


@query("entity_resolve", "SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&apos;', '''') AS html FROM pages")
def entity_resolve(spark, folder):
    return read_table(spark, folder, "pages").select("page_id", reports.resolve_entities(F.col("html")).alias("html"))


@query("page_xml", "SELECT doc_id, concat('<page index=\"', doc_id, '\" lang=\"', lang, '\" chars=\"', length(text), '\"/>') AS xml FROM documents")
def page_xml(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", F.format_string('<page index="%d" lang="%s" chars="%d"/>', F.col("doc_id"), F.col("lang"), F.length("text")).alias("xml"))


@query("info_json", "SELECT source, concat('{\"source\":\"', source, '\",\"pages\":', count(*), ',\"chars\":', sum(n_chars), '}') AS info FROM documents GROUP BY source")
def info_json(spark, folder):
    sums = read_table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_chars").alias("chars"))
    return sums.select("source", F.to_json(F.struct("source", "pages", "chars")).alias("info"))


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, folder):
    return read_table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
