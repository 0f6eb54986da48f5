"""Queries over documents as objects: lookups, packed streams, code maps, form data, page lists, blocks and output."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import color, crypto, numeric, raster
from weft.functions import text as T
from weft.functions.postscript import compile_program
from weft.operators import pages as P
from weft.operators import pixels, search
from weft.plans.registry import query
from weft.plans.reports import _ROWS, _rows
from weft.plans.texts import _SPANS, _starts
from weft.sources import objects, read_table, reports

# --- search results ---


@query("search_match_arrays", f"""SELECT doc_id, string_agg("start" || '-' || "end", ',' ORDER BY "start") AS matches FROM ({_starts("anti")}) GROUP BY doc_id""")
def search_match_arrays(spark, folder):
    found = search.matches_by_page(search.find_matches(read_table(spark, folder, "documents"), "anti"))
    return found.select("doc_id", F.array_join(F.transform("matches", lambda m: F.concat_ws("-", m["start"], m["end"])), ",").alias("matches"))


@query("searched_pages", f"SELECT count(DISTINCT doc_id) AS pages, count(*) AS matches FROM ({_starts('anti')})")
def searched_pages(spark, folder):
    return search.searched_pages(search.find_matches(read_table(spark, folder, "documents"), "anti"))


# --- objects ---


@query(
    "object_fetch",
    """SELECT c_custkey, coalesce(l.place, CASE WHEN c_custkey % 5 = 0 THEN 1000 + c_custkey END, -1) AS place FROM customer LEFT JOIN
       (SELECT o_custkey, arg_max(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS place FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey) l ON c_custkey = l.o_custkey""",
)
def object_fetch(spark, folder):
    customers = read_table(spark, folder, "customer").select("c_custkey")
    entries = read_table(spark, folder, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.floor("o_totalprice").alias("place"))
    found = customers.where("c_custkey % 5 = 0").select("c_custkey", (1000 + F.col("c_custkey")).alias("place"))
    return objects.fetch(customers, entries, found, ["c_custkey"], "place", "o_orderkey").withColumn("place", F.coalesce("place", F.lit(-1).cast("bigint")))


@query("dereference", "SELECT o_orderkey, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 <> 0")
def dereference(spark, folder):
    values = read_table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("ref"))
    known = read_table(spark, folder, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("ref"), F.col("c_name").alias("name"))
    return objects.dereference(values, known, "ref", "name").select("o_orderkey", "name")


@query("object_stream", "SELECT c_nationkey, c_custkey AS num, c_mktsegment AS body FROM customer")
def object_stream(spark, folder):
    """Streams are packed, and read again.  A body is a string in parentheses, or null."""
    body = F.coalesce(F.concat(F.lit("("), "c_mktsegment", F.lit(")")), F.lit("null"))
    so_far = Window.partitionBy("c_nationkey").orderBy("c_custkey", "body").rowsBetween(Window.unboundedPreceding, -1)
    placed = read_table(spark, folder, "customer").select("c_nationkey", "c_custkey", body.alias("body")).withColumn("at", F.coalesce(F.sum(F.octet_length("body")).over(so_far), F.lit(0)))
    packed = placed.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("at", "c_custkey", "body"))).alias("rows"))
    head = F.array_join(F.transform("rows", lambda r: F.concat(F.coalesce(r["c_custkey"].cast("string"), F.lit("null")), F.lit(" "), r["at"].cast("string"), F.lit(" "))), "")
    streams = packed.select("c_nationkey", F.size("rows").alias("n"), head.alias("head"), F.array_join(F.transform("rows", lambda r: r["body"]), "").alias("bodies"))
    data = F.concat("head", "bodies").cast("binary")
    read = streams.select("c_nationkey", F.explode(objects.object_stream(data, F.col("n"), F.octet_length("head"))).alias("o"))
    text = F.col("o.body").cast("string")
    return read.select("c_nationkey", F.col("o.num").alias("num"), F.when(text != "null", F.substring(text, F.lit(2), F.length(text) - 2)).alias("body"))


@query(
    "code_map",
    """SELECT s_suppkey, '01' AS code, chr(CAST(65 + s_suppkey % 20 AS INTEGER)) AS text FROM supplier
       UNION ALL SELECT s_suppkey, '0203', 'Hi' FROM supplier
       UNION ALL SELECT s_suppkey, format('{:02X}', n), CASE WHEN n = 33 THEN '?' ELSE chr(CAST(97 + s_suppkey % 10 + n - 32 AS INTEGER)) END FROM supplier, range(32, 48) t(n)
       UNION ALL SELECT s_suppkey, format('{:02X}', n), chr(CAST(120 + n - 48 AS INTEGER)) FROM supplier, range(48, 51) t(n)
       UNION ALL SELECT s_suppkey, '40', chr(65) FROM supplier""",
)
def code_map(spark, folder):
    text = F.format_string(
        "begincmap %% <09> <0041>\n1 begincodespacerange <00> <FF> endcodespacerange\n2 beginbfchar\n<01> <%04X>\n<0203><00480069>\nendbfchar\n"
        "3 beginbfrange\n<20> <2F> <%04X>\n<30> <33> [<0078> <0079> <007A>]\n<50> <4F> <0041>\nendbfrange\n2 beginbfchar <21> <003F> <4> <41> endbfchar\nendcmap",
        65 + F.col("s_suppkey") % 20, 97 + F.col("s_suppkey") % 10,
    )
    return objects.code_map(read_table(spark, folder, "supplier").select("s_suppkey", text.alias("cmap")), "s_suppkey", "cmap")


_FORM = r"""SELECT c_nationkey, 'f(' || c_custkey || ')\' AS name, CASE WHEN c_custkey % 3 = 0 THEN [c_mktsegment, 'a\b(c)' || chr(10) || '.'] WHEN c_custkey % 3 = 1 THEN [c_name] ELSE [''] END AS vs FROM customer"""


@query("form_data_objects", f"SELECT c_nationkey, name, array_to_string(vs, '|') AS vs FROM ({_FORM})")
def form_data_objects(spark, folder):
    """Forms are written as objects, and read again."""
    k = F.col("c_custkey")
    values = F.when(k % 3 == 0, F.array("c_mktsegment", F.lit("a\\b(c)\n."))).when(k % 3 == 1, F.array("c_name")).otherwise(F.array().cast("array<string>"))
    fields = read_table(spark, folder, "customer").select("c_nationkey", F.concat(F.lit("f("), k.cast("string"), F.lit(")\\")).alias("name"), values.alias("vs"))
    forms = objects.form_data_objects(fields, "c_nationkey", "name", "vs")
    read = forms.select("c_nationkey", F.explode(objects.form_data_fields(F.decode("data", "ISO-8859-1"))).alias("f"))
    return read.select("c_nationkey", F.col("f.name").alias("name"), F.array_join("f.values", "|").alias("vs"))


# --- page lists and trees ---


@query(
    "merge_documents",
    """SELECT job, row_number() OVER (PARTITION BY job ORDER BY part, source_page) - 1 AS page, part, source_page
       FROM (SELECT c_nationkey AS job, c_custkey AS part, unnest(range(c_custkey % 4)) AS source_page FROM customer)""",
)
def merge_documents(spark, folder):
    parts = read_table(spark, folder, "customer").select(F.col("c_nationkey").alias("job"), F.col("c_custkey").alias("part"), (F.col("c_custkey") % 4).alias("n"))
    return P.merge_documents(parts, "job", "part", "n")


@query(
    "import_pages",
    """SELECT p_partkey, array_to_string(list_concat(list_concat(list_slice(base, 1, head), list_slice(other, least(2, len(other)), least(4, len(other)))), list_slice(base, head + 1, len(base))), ',') AS pages
       FROM (SELECT p_partkey, range(1, p_size + 1) AS base, range(101, 102 + p_size % 7) AS other, CASE WHEN p_size < 3 THEN p_size ELSE 3 END AS head FROM part)""",
)
def import_pages(spark, folder):
    size = F.col("p_size").cast("int")
    out = P.import_after(F.sequence(F.lit(1), size), F.sequence(F.lit(101), 101 + size % 7), 3, 2, 4)
    return read_table(spark, folder, "part").select("p_partkey", F.array_join(F.transform(out, lambda p: p.cast("string")), ",").alias("pages"))


@query("page_leaves", "SELECT n_regionkey AS root, row_number() OVER (PARTITION BY n_regionkey ORDER BY -n_nationkey, c_custkey % 7, c_custkey) - 1 AS page, 'p' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def page_leaves(spark, folder):
    nations = read_table(spark, folder, "nation")
    regions = read_table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("root"), F.lit("top").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("pos"), F.lit(False).alias("is_page"))
    inner = nations.select(F.col("n_regionkey").cast("long"), F.concat(F.lit("n"), "n_nationkey"), F.lit("top"), (-F.col("n_nationkey")).cast("long"), F.lit(False))
    customers = read_table(spark, folder, "customer").join(F.broadcast(nations.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    leaves = customers.select(F.col("n_regionkey").cast("long"), F.concat(F.lit("p"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), (F.col("c_custkey") % 7 * 1_000_000_000 + F.col("c_custkey")).cast("long"), F.lit(True))
    return P.page_leaves(spark, regions.union(inner).union(leaves)).select("root", F.col("page").cast("long").alias("page"), "id")


@query("terminal_fields", "SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region WHERE r_regionkey % 2 = 0 OR r_regionkey NOT IN (SELECT n_regionkey FROM nation)")
def terminal_fields(spark, folder):
    regions = read_table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), (F.col("r_regionkey") % 2 == 0).alias("own"))
    nations = read_table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(False))
    return P.terminal_fields(regions.union(nations), "id", "parent", F.col("own")).select("id")


# --- output and blocks of pages ---


@query("page_output", "SELECT conv_id, string_agg('--- Page ' || turn || ' ---' || chr(10) || text || chr(10), chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def page_output(spark, folder):
    return P.page_output(read_table(spark, folder, "conversations"), "conv_id", "turn", "text")


@query("positioned_text", "SELECT event_id, printf('[%.2f,%.2f] %s', event_id % 500 / 4.0::DOUBLE, (event_id % 300)::DOUBLE, event_type) AS line FROM events")
def positioned_text(spark, folder):
    return read_table(spark, folder, "events").select("event_id", P.positioned(F.col("event_id") % 500 / 4.0, F.col("event_id") % 300, F.col("event_type")).alias("line"))


@query("column_list", "SELECT doc_id + 1 AS page, 0 AS flow, 0 AS \"column\", coalesce(text, '') AS styled FROM documents")
def column_list(spark, folder):
    return P.column_list(read_table(spark, folder, "documents"), "doc_id", "text")


@query("image_blocks", r"SELECT page_id, CAST(image AS INTEGER) AS image, '0,0,612,792' AS block FROM (SELECT page_id, unnest(range(1, len(regexp_extract_all(html, '<(?:img|a|p)\b')) + 1)) AS image FROM pages)")
def image_blocks(spark, folder):
    pages = read_table(spark, folder, "pages").select("page_id", F.regexp_count("html", F.lit(r"<(?:img|a|p)\b")).alias("n"))
    return P.image_blocks(pages, F.col("n"), F.array(*map(F.lit, (0, 0, 612, 792)))).select("page_id", "image", F.array_join(F.transform("block", lambda v: v.cast("string")), ",").alias("block"))


@query(
    "highlight_range",
    f"""SELECT conv_id, substr(body, 101, 50) AS "match", x0, y0, x1, y1 FROM (
            SELECT conv_id, string_agg(text, '' ORDER BY span_start) AS body, CAST(min(0) FILTER (hit) AS INTEGER) AS x0, CAST(min(turn * 20) FILTER (hit) AS BIGINT) AS y0,
                   CAST(max(n) FILTER (hit) AS INTEGER) AS x1, CAST(max(turn * 20 + 12) FILTER (hit) AS BIGINT) AS y1
            FROM (SELECT *, span_start + n > 100 AND span_start < 150 AS hit FROM {_SPANS}) GROUP BY conv_id) WHERE length(body) > 100""",
)
def highlight_range(spark, folder):
    spans = search.item_spans(read_table(spark, folder, "conversations"), "conv_id", "turn", "text")
    boxed = spans.select("conv_id", "text", "span_start", "span_end", F.lit(0).alias("x0"), (F.col("turn") * 20).cast("bigint").alias("y0"), F.length("text").alias("x1"), (F.col("turn") * 20 + 12).cast("bigint").alias("y1"))
    return P.highlight(boxed, "conv_id", "text", 150, 100)


@query(
    "quad_envelopes",
    """SELECT event_id, CAST(to_json(CASE event_id % 3 WHEN 0 THEN [[least(v, 7), 1, greatest(v, 9), greatest(5, w)]] WHEN 1 THEN [[least(v, 3), least(w, 4), greatest(v, 3), greatest(w, 4)]] END) AS VARCHAR) AS quads
       FROM (SELECT event_id, CAST(floor(value) AS INTEGER) AS v, CAST(10 + event_id % 90 AS INTEGER) AS w FROM events) WHERE event_id % 3 < 2""",
)
def quad_envelopes(spark, folder):
    v, w = F.floor("value").cast("int"), (10 + F.col("event_id") % 90).cast("int")
    lists = F.when(F.col("event_id") % 3 == 0, F.array(v, F.lit(1), F.lit(7), w, F.lit(9), F.lit(5), F.lit(8), F.lit(2))).when(F.col("event_id") % 3 == 1, F.array(v, w, F.lit(3), F.lit(4))).otherwise(F.array(v, w, F.lit(3)))
    return read_table(spark, folder, "events").select("event_id", P.quads(lists).alias("q")).where("q is not null").select("event_id", F.to_json("q").alias("quads"))


# --- texts ---


@query("text_fallback", r"SELECT doc_id, CASE WHEN doc_id % 3 = 2 AND coalesce(r >= 0.8, false) THEN text ELSE 'layer ' || lang END AS text FROM (SELECT *, CASE WHEN length(trim(text)) > 0 THEN length(regexp_replace(trim(text), '[^\p{L}\p{M}\p{N}\p{P}\p{S} ]|\x{FFFD}', '', 'g')) / length(trim(text)) END AS r FROM documents)")
def text_fallback(spark, folder):
    k = F.col("doc_id") % 3
    first = F.when(k == 0, F.lit("")).when(k == 1, F.repeat(F.lit("\u0001�"), 9)).otherwise(F.col("text"))
    return read_table(spark, folder, "documents").select("doc_id", T.first_readable(first, F.concat(F.lit("layer "), "lang")).alias("text"))


@query("unicode_categories", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{Z}\t\n\x{0B}\f\r\x{85}]')) AS INTEGER) AS spaces, CAST(len(regexp_extract_all(text, '\p{Mn}')) AS INTEGER) AS marks, CAST(len(regexp_extract_all(text, '\p{Cf}')) AS INTEGER) AS formats FROM documents")
def unicode_categories(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", T.category_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("symbol_mapping", "SELECT doc_id, '©' || lang || '-™)' AS text FROM documents")
def symbol_mapping(spark, folder):
    raw = F.concat(F.lit(""), "lang", F.lit("­￼)"))
    return read_table(spark, folder, "documents").select("doc_id", T.map_symbols(raw).alias("text"))


@query("decode_cascade", "SELECT doc_id, lang || 'é' || CASE WHEN doc_id % 3 = 2 THEN '' ELSE 'ł' END AS text FROM documents")
def decode_cascade(spark, folder):
    k, wide = F.col("doc_id") % 3, F.concat("lang", F.lit("éł"))
    raw = F.when(k == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode(wide, "UTF-16BE"))).when(k == 1, F.encode(wide, "UTF-8")).otherwise(F.encode(F.concat("lang", F.lit("é")), "ISO-8859-1"))
    return read_table(spark, folder, "documents").select("doc_id", T.decode_text(raw).alias("text"))


@query("font_names", "SELECT p_partkey, replace(p_name, ' ', '-') AS font, format('{:,}', CAST(p_partkey * 977 AS BIGINT)) AS number FROM part")
def font_names(spark, folder):
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("/ABCDEF+")).otherwise(F.lit("/")), F.replace("p_name", F.lit(" "), F.lit("-")))
    return read_table(spark, folder, "part").select("p_partkey", T.base_font_name(name).alias("font"), T.thousands(F.col("p_partkey") * 977).alias("number"))


@query(
    "text_positions",
    """SELECT user_id, event_id, round(coalesce(sum(a) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS x
       FROM (SELECT user_id, event_id, ((250 + event_id % 500) / 1024.0::DOUBLE * s + 0.5 + CASE WHEN event_type = 'click' THEN 2.0 ELSE 0.0 END) * 0.75::DOUBLE - (event_id % 4) * 125 / 1000.0::DOUBLE * CASE WHEN s = 0 THEN 12 ELSE s END * 0.75::DOUBLE AS a
             FROM (SELECT *, CAST(event_id % 3 * 10 AS DOUBLE) AS s FROM events))""",
)
def text_positions(spark, folder):
    """All steps are binary fractions, so sums are exact in any order."""
    from pyspark.sql import Window

    size = (F.col("event_id") % 3 * 10).cast("double")
    width = 250 + F.col("event_id") % 500
    step = numeric.text_advance(width, 1024.0, size, F.lit(0.5), F.lit(2.0), F.col("event_type") == "click", 0.75) + numeric.text_adjustment(F.col("event_id") % 4 * 125, size, 0.75)
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return read_table(spark, folder, "events").select("user_id", "event_id", F.round(F.coalesce(F.sum(step).over(before), F.lit(0.0)), 6).alias("x"))


# --- bytes, maps, colours ---


@query("block_ciphers", "SELECT doc_id, lang || source AS ecb, source AS cbc FROM documents")
def block_ciphers(spark, folder):
    key, start = F.lit("0123456789abcdef").cast("binary"), F.lit("fedcba9876543210").cast("binary")
    ecb = F.aes_encrypt(F.concat("lang", "source").cast("binary"), key, F.lit("ECB"), F.lit("PKCS"))
    cbc = F.aes_encrypt(F.col("source").cast("binary"), key, F.lit("CBC"), F.lit("PKCS"), start)
    return read_table(spark, folder, "documents").select("doc_id", crypto.decrypt_ecb(ecb, key).cast("string").alias("ecb"), crypto.decrypt_cbc(cbc, key).cast("string").alias("cbc"))


@query("map_functions", "SELECT event_id, json_extract_string(props, '$.k') AS got, json_extract_string(props, '$.kind') IS NOT NULL AS has, array_to_string(json_keys(props), ',') AS keys FROM events")
def map_functions(spark, folder):
    """A value under the first of its keys that is there."""
    entries = F.from_json("props", "map<string,string>")
    got = F.coalesce(F.try_element_at(entries, F.lit("kind")), F.try_element_at(entries, F.lit("k")))
    return read_table(spark, folder, "events").select("event_id", got.alias("got"), F.map_contains_key(entries, "kind").alias("has"), F.array_join(F.map_keys(entries), ",").alias("keys"))


@query("calibrated_gray", "SELECT p_partkey, CAST(floor(least(255, greatest(0, 295.8 * cbrt(pow((p_partkey % 101) / 100.0::DOUBLE, 2.2)) - 40.8))) AS INTEGER) AS v FROM part")
def calibrated_gray(spark, folder):
    return read_table(spark, folder, "part").select("p_partkey", color.calibrated_gray(F.col("p_partkey") % 101 / 100.0, 2.2)[0].alias("v"))


def _mix(names: str, rows) -> str:
    """SQL: a matrix applied to three columns, as three columns of the same names."""
    a, b, c = names
    return ", ".join(f"({r[0]}) * {a} + ({r[1]}) * {b} + ({r[2]}) * {c} AS {n}" for r, n in zip(rows, names))


_CONES, _BACK = _mix("xyz", color.TO_CONES), _mix("xyz", color.FROM_CONES)
_CURVE = "CASE WHEN {0} <= 0.0031308 THEN least(1, greatest(0, 12.92 * {0})) WHEN {0} >= 0.99554525 THEN 1 ELSE 1.055 * pow({0}, 1 / 2.4::DOUBLE) - 0.055 END"


@query(
    "calibrated_rgb",
    f"""WITH s AS (SELECT p_partkey, pow((p_partkey % 11) / 10.0::DOUBLE, 1.8) AS x, pow((p_partkey % 7) / 6.0::DOUBLE, 1.9) AS y, pow((p_partkey % 5) / 4.0::DOUBLE, 2.0) AS z FROM part),
            m AS (SELECT p_partkey, 0.41 * x + 0.36 * y + 0.18 * z AS x, 0.21 * x + 0.72 * y + 0.07 * z AS y, 0.02 * x + 0.12 * y + 0.95 * z AS z FROM s),
            c AS (SELECT p_partkey, {_CONES} FROM m), f AS (SELECT p_partkey, x / 0.9505 AS x, y AS y, z / 1.089 AS z FROM c), b AS (SELECT p_partkey, {_BACK} FROM f),
            d AS (SELECT p_partkey, {_CONES} FROM b), w AS (SELECT p_partkey, x * 0.95047 AS x, y AS y, z * 1.08883 AS z FROM d), e AS (SELECT p_partkey, {_BACK} FROM w),
            l AS (SELECT p_partkey, {_mix("xyz", color.XYZ_TO_LINEAR)} FROM e)
       SELECT p_partkey, {", ".join(f"CAST(round(255 * ({_CURVE.format(c)})) AS INTEGER) AS {n}" for c, n in zip("xyz", "rgb"))} FROM l""",
)
def calibrated_rgb(spark, folder):
    k = F.col("p_partkey")
    rgb = color.calibrated_rgb([k % 11 / 10.0, k % 7 / 6.0, k % 5 / 4.0], (0.9505, 1.0, 1.089), (1.8, 1.9, 2.0), (0.41, 0.36, 0.18, 0.21, 0.72, 0.07, 0.02, 0.12, 0.95))
    return read_table(spark, folder, "part").select("p_partkey", *[v.alias(n) for v, n in zip(rgb, "rgb")])


@query("color_spaces", "SELECT p_partkey, CASE least(greatest(p_partkey % 5 - 1, 0), 2) WHEN 0 THEN '255,0,0' WHEN 1 THEN '0,128,255' ELSE '7,8,9' END AS indexed, CAST(round((1 - (p_partkey % 3) * 0.4) * 255) AS INTEGER) AS tint FROM part")
def color_spaces(spark, folder):
    k = F.col("p_partkey")
    palette = color.color_space(("Indexed", "DeviceRGB", 2, (255, 0, 0, 0, 128, 255, 7, 8, 9)))(k % 5 - 1)
    tint = color.color_space(("Separation", lambda t: numeric.exponential(t, (1.0,), (0.2,), 1.0), ("ICCBased", 1)))(k % 3 / 2.0)
    return read_table(spark, folder, "part").select("p_partkey", F.concat_ws(",", *palette).alias("indexed"), tint[0].alias("tint"))


@query("calculator_bitwise", "SELECT p_partkey, CAST((p_size & 12) | (xor(p_size, 5)) AS DOUBLE) AS a, CAST(p_size << 3 AS DOUBLE) AS b, CAST(p_size >> 2 AS DOUBLE) AS c, CAST(-p_size - 1 AS DOUBLE) AS d, floor(-p_size / 4.0::DOUBLE) AS e, CASE WHEN p_size = 25 THEN 0.0 ELSE round(((degrees(atan2(p_size - 25, 10)) % 360) + 360) % 360, 6) END AS f FROM part")
def calculator_bitwise(spark, folder):
    program = "{ dup dup 12 and exch 5 xor or exch dup 3 bitshift exch dup -2 bitshift exch dup not exch dup neg 4 div cvi exch 25 sub 10 atan }"
    out = compile_program(program, F.col("p_size"), bitwise=True)
    return read_table(spark, folder, "part").select("p_partkey", *[(F.round(v, 6) if n == "f" else v).alias(n) for v, n in zip(out, "abcdef")])


@query("sample_decode", "SELECT p_partkey, greatest(0.0, least(255.0, 255 * 0.25 + p_size * 0.5)) AS plain, round(greatest(0.0, least(15.0, 3 + p_size * 9 / 15.0::DOUBLE))) AS indexed, concat_ws(',', CAST(round(p_size * 0.37::DOUBLE * 3.0) AS BIGINT), CAST(round(p_size * -0.5::DOUBLE * 3.0) AS BIGINT)) AS points FROM part")
def sample_decode(spark, folder):
    size = F.col("p_size").cast("double")
    return read_table(spark, folder, "part").select(
        "p_partkey", color.decode_sample(size, 0.25, 0.75, 255.0, False).alias("plain"), color.decode_sample(size, 3.0, 12.0, 15.0, True).alias("indexed"), F.array_join(F.transform(numeric.device_points(F.array(size * 0.37, size * -0.5), 3.0), lambda v: v.cast("string")), ",").alias("points")
    )


# --- images and reports ---

_IMAGES = "(SELECT p_partkey % 50 AS x, p_partkey // 50 AS y, p_size * 5 AS a, CASE WHEN p_partkey % 50 < 40 THEN p_size * 5 + CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END END AS b FROM part)"


def _images(spark, folder):
    k = F.col("p_partkey")
    cells = read_table(spark, folder, "part").select((k % 50).alias("x"), F.floor(k / 50).alias("y"), (F.col("p_size") * 5).alias("v"), k)
    return cells.select("x", "y", "v"), cells.where("x < 40").select("x", "y", (F.col("v") + F.when(k % 7 == 0, 2).otherwise(0)).alias("v"))


@query("image_sizes_differ", f"SELECT count(*) FILTER (a = b) AS matched, CAST(50 * (max(y) + 1) AS BIGINT) AS total, round(100.0 * count(*) FILTER (a = b) / (50 * (max(y) + 1)), 6) AS exact_percent FROM {_IMAGES}")
def image_sizes_differ(spark, folder):
    out = pixels.compare_images(*_images(spark, folder), ["v"])
    return out.withColumn("exact_percent", F.round("exact_percent", 6))


@query(
    "image_padded",
    f"""SELECT count(*) AS total, count(*) FILTER (a = p) AS matched, CAST(sum(abs(a - p)) AS BIGINT) AS abs_delta, round(100.0 * count(*) FILTER (a = p) / count(*), 6) AS exact_percent,
               round(greatest(0, 100 - 100.0 * sum(abs(a - p)) / (count(*) * 255.0)), 6) AS similarity_percent FROM (SELECT *, coalesce(b, 255) AS p FROM {_IMAGES})""",
)
def image_padded(spark, folder):
    out = pixels.compare_images(*_images(spark, folder), ["v"], white=255)
    return out.withColumns({"exact_percent": F.round("exact_percent", 6), "similarity_percent": F.round("similarity_percent", 6)})


@query("worst_pages_mae", f"SELECT pdf, page, exact, round(100 - similarity, 4) AS mae FROM {_ROWS} ORDER BY exact, round(100 - similarity, 4), pdf, page, l_suppkey, l_partkey LIMIT 25")
def worst_pages_mae(spark, folder):
    """Equal pages stay in the order of the file, which these rows take from their keys."""
    rows = _rows(spark, folder).withColumn("mae", F.round(100 - F.col("similarity"), 4))
    return rows.orderBy("exact", "mae", "pdf", "page", "l_suppkey", "l_partkey").limit(25).select("pdf", "page", "exact", "mae")


@query("prefix_and_errors", f"SELECT pdf, page, status FROM {_ROWS} WHERE NOT error AND starts_with(CAST(pdf AS VARCHAR), '1')")
def prefix_and_errors(spark, folder):
    rows = _rows(spark, folder)
    return rows.where(~F.col("error") & F.col("pdf").cast("string").startswith("1")).select("pdf", "page", "status")


@query("parity_csv_lines", f"SELECT pdf || ',' || page || ',' || printf('%.9f', CAST(exact AS DOUBLE)) || ',' || printf('%.9f', round(similarity, 2)) || ',' || CASE WHEN exact >= 90 THEN 'true' ELSE 'false' END AS line FROM {_ROWS}")
def parity_csv_lines(spark, folder):
    passed = F.when(F.col("exact") >= 90, "true").otherwise("false")
    return _rows(spark, folder).select(F.format_string("%d,%d,%.9f,%.9f,%s", "pdf", "page", F.col("exact").cast("double"), F.round("similarity", 2), passed).alias("line"))


@query(
    "parity_summary",
    f"""SELECT '# Summary' || chr(10) || chr(10) || '- Threshold: `95.00%`' || chr(10) || '- Total rows: `' || count(*) || '`' || chr(10) || '- Page rows: `' || count(*) FILTER (page > 2) || '`' || chr(10) ||
               '- Pass pages: `' || count(*) FILTER (page > 2 AND similarity >= 95) || '`' || chr(10) || '- Error rows: `' || count(*) FILTER (error) || '`' AS summary FROM {_ROWS}""",
)
def parity_summary(spark, folder):
    """Rows of the first two pages stand for rows without a page."""
    from weft.operators.reports import markdown_summary

    return markdown_summary(_rows(spark, folder), 95.0, F.col("page") > 2, F.col("similarity") >= 95, F.col("error"))


@query("glyph_names", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN chr(CAST(65 + p_partkey % 26 AS INTEGER)) WHEN 1 THEN '[' WHEN 2 THEN chr(CAST(1024 + p_partkey % 200 AS INTEGER)) WHEN 3 THEN '😀' END AS text FROM part")
def glyph_names(spark, folder):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.char(65 + k % 26)).when(k % 5 == 1, F.lit("bracketleft.alt")).when(k % 5 == 2, F.format_string("uni%04X", 1024 + k % 200)).when(k % 5 == 3, F.lit("u1F600")).otherwise(F.lit("nothing"))
    return read_table(spark, folder, "part").select("p_partkey", T.glyph_text(name).alias("text"))


@query("rdf_properties", "SELECT c_custkey, c_name || ' & co' AS title, c_mktsegment || '|' || c_nationkey AS creators, '3' AS pages FROM customer")
def rdf_properties(spark, folder):
    xml = F.concat(
        F.lit('<x:xmpmeta><rdf:RDF><rdf:Description about=""><dc:Title>old</dc:Title><dc:Title>\n<rdf:Alt><rdf:li xml:lang="x">'), "c_name", F.lit(" &amp; co</rdf:li></rdf:Alt> </dc:Title><pdf:Pages>3</pdf:Pages></rdf:Description><rdf:Description><dc:creator><rdf:Seq><rdf:li>"),
        "c_mktsegment", F.lit("</rdf:li>\n<rdf:li>"), F.col("c_nationkey").cast("string"), F.lit("</rdf:li></rdf:Seq></dc:creator></rdf:Description></rdf:RDF></x:xmpmeta>"),
    )
    rows = read_table(spark, folder, "customer").repartition("c_custkey")  # rows are small and dear: one file of them would be one task
    found = rows.select("c_custkey", reports.rdf_properties(xml).alias("m"))
    value = lambda name: F.array_join(F.try_element_at("m", F.lit(name)), "|")
    return found.select("c_custkey", value("dc:title").alias("title"), value("dc:creator").alias("creators"), value("pdf:pages").alias("pages"))


@query("annotations_by_type", "SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def annotations_by_type(spark, folder):
    return reports.annotations(read_table(spark, folder, "events"), kind="click", kind_column="event_type").select("event_id", "user_id")


_TRIANGLE = "SELECT *, ((x - 10) * 60 - (y - 5) * 20) / 4600.0::DOUBLE AS b, ((y - 5) * 80 - (x - 10) * 10) / 4600.0::DOUBLE AS c FROM (SELECT p_partkey, p_partkey % 100 AS x, p_size + p_partkey % 40 AS y FROM part)"


@query("triangle_shading", f"SELECT p_partkey, round(CASE WHEN b >= 0 AND c >= 0 AND b + c <= 1 THEN 10 + b * 190 + c * 40 END, 6) AS v FROM ({_TRIANGLE})")
def triangle_shading(spark, folder):
    k = F.col("p_partkey")
    v = raster.triangle(k % 100, F.col("p_size") + k % 40, ((10.0, 5.0), (90.0, 15.0), (30.0, 65.0)), ((10.0,), (200.0,), (50.0,)))[0]
    return read_table(spark, folder, "part").select("p_partkey", F.round(v, 6).alias("v"))


@query("soft_mask", "SELECT p_partkey, CAST((v + (v >> 8) + 128) >> 8 AS INTEGER) AS alpha FROM (SELECT p_partkey, p_partkey * 37 % 256 * (p_size * 5) AS v FROM part)")
def soft_mask(spark, folder):
    return read_table(spark, folder, "part").select("p_partkey", raster.soft_mask((F.col("p_partkey") * 37 % 256).cast("int"), (F.col("p_size") * 5).cast("int")).alias("alpha"))


@query(
    "enlarge_bilinear",
    """WITH p AS (SELECT n_nationkey % 5 AS x, n_nationkey // 5 AS y, n_nationkey * 37 % 256 AS v FROM nation),
            t AS (SELECT x, y, x * (5 / 12.0::DOUBLE) AS u, y * 0.5::DOUBLE AS w FROM range(12) a(x), range(10) b(y)),
            c AS (SELECT t.x, t.y, u - floor(u) AS f, w - floor(w) AS g, least(floor(u), 4) AS x0, least(floor(u) + 1, 4) AS x1, least(floor(w), 4) AS y0, least(floor(w) + 1, 4) AS y1 FROM t)
       SELECT c.x, c.y, CAST(floor(a.v * (1 - f) * (1 - g) + b.v * f * (1 - g) + d.v * (1 - f) * g + e.v * f * g + 1e-9) AS INTEGER) AS v FROM c
       JOIN p a ON a.x = x0 AND a.y = y0 JOIN p b ON b.x = x1 AND b.y = y0 JOIN p d ON d.x = x0 AND d.y = y1 JOIN p e ON e.x = x1 AND e.y = y1""",
)
def enlarge_bilinear(spark, folder):
    k = F.col("n_nationkey")
    pixels = read_table(spark, folder, "nation").select((k % 5).cast("long").alias("x"), F.floor(k / 5).alias("y"), (k * 37 % 256).alias("v"))
    return raster.enlarge(pixels, (5, 5), (12, 10), ["v"]).select(F.col("x").cast("long"), F.col("y").cast("long"), "v")
