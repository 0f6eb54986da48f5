"""Numeric kernels on columns derived from order lines and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import color, numeric, postscript
from weft.functions import text as T
from weft.operators import pixels as P
from weft.plans.registry import query
from weft.sources import read_table
from weft.sources.reports import page_spec

_KEYS = "l_orderkey, l_linenumber"


def _line(spark, folder, *columns):
    return read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *columns)


# --- interpolation functions ---

_X = "l_discount * 10"


@query("fn_exponential", f"SELECT {_KEYS}, round(0.1 + 0.8 * pow({_X}, 1.7), 6) AS y0, round(least(0.9, 1 - 0.5 * pow({_X}, 1.7)), 6) AS y1 FROM lineitem")
def fn_exponential(spark, folder):
    y = numeric.exponential(F.col("l_discount") * 10, (0.1, 1.0), (0.9, 0.5), 1.7, (0.0, 1.0), ((0.0, 1.0), (0.0, 0.9)))
    return _line(spark, folder, *[F.round(v, 6).alias(f"y{i}") for i, v in enumerate(y)])


@query(
    "fn_stitching",
    f"""SELECT {_KEYS}, round(CASE WHEN x < 0.25 THEN (x / 0.25) * 2 WHEN x < 0.5 THEN pow(1 - (x - 0.25) / 0.25, 2) ELSE 3 + (x - 0.5) / 0.5 END, 6) AS y
        FROM (SELECT *, greatest(0.0, least(1.0, {_X})) AS x FROM lineitem)""",
)
def fn_stitching(spark, folder):
    x = F.col("l_discount") * 10
    return _line(spark, folder, F.round(numeric.stitching(x, (0.25, 0.5), ((0, 1), (1, 0), (0, 1)), (lambda e: e * 2, lambda e: F.pow(e, F.lit(2.0)), lambda e: e + 3)), 6).alias("y"))


@query(
    "fn_sampled_1d",
    f"""SELECT {_KEYS}, round(s[CAST(floor(a) AS INTEGER) + 1] + (s[CAST(ceil(a) AS INTEGER) + 1] - s[CAST(floor(a) AS INTEGER) + 1]) * (a - floor(a)), 6) AS y
        FROM (SELECT *, (least(l_quantity, 40) - 1) * 4 / 39 AS a, [0.0, 0.5, 0.25, 1.0, 0.75] AS s FROM lineitem)""",
)
def fn_sampled_1d(spark, folder):
    return _line(spark, folder, F.round(numeric.sampled(F.col("l_quantity"), (0.0, 0.5, 0.25, 1.0, 0.75), (1.0, 40.0)), 6).alias("y"))


_PROGRAM = "{ dup 25 gt { 2 div 3 exch sub } { dup mul 1 add } ifelse exch dup 0 lt { neg } if sqrt 2 copy add 3 1 roll exch pop exch }"


@query(
    "fn_postscript",
    f"""SELECT {_KEYS}, round(sqrt(l_discount) + CASE WHEN l_quantity > 25 THEN 3 - l_quantity / 2 ELSE l_quantity * l_quantity + 1 END, 6) AS y0, round(sqrt(l_discount), 6) AS y1 FROM lineitem""",
)
def fn_postscript(spark, folder):
    """Inputs: discount below quantity; the program leaves a sum and a root."""
    y = postscript.compile_program(_PROGRAM, F.col("l_discount"), F.col("l_quantity"))
    return _line(spark, folder, F.round(y[1], 6).alias("y0"), F.round(y[0], 6).alias("y1"))


@query("segment_index", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 35 THEN 2 ELSE 3 END AS INTEGER) AS segment FROM lineitem")
def segment_index(spark, folder):
    return _line(spark, folder, numeric.segment(F.col("l_quantity"), (10, 20, 35)).alias("segment"))


# --- colours ---

_BYTES = "l_partkey * 37 % 256 AS a, l_suppkey * 91 % 256 AS b, l_orderkey % 256 AS c, (l_linenumber * 40 + CAST(l_quantity AS BIGINT)) % 256 AS d"


def _bytes(spark, folder):
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") * 37 % 256).cast("int").alias("a"), (F.col("l_suppkey") * 91 % 256).cast("int").alias("b"), (F.col("l_orderkey") % 256).cast("int").alias("c"), ((F.col("l_linenumber") * 40 + F.col("l_quantity").cast("bigint")) % 256).cast("int").alias("d")
    )


def _abcd():
    return [F.col(x) for x in "abcd"]


def _corner_sql(channel: int) -> str:
    terms = []
    for bits, rgb in color.CMYK_CORNERS.items():
        if rgb[channel]:
            weight = " * ".join(v if bit == "1" else f"(1 - {v})" for bit, v in zip(bits, ("cc", "mm", "yy", "kk")))
            terms.append(weight if rgb[channel] == 1.0 else f"{weight} * CAST({rgb[channel]} AS DOUBLE)")
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {' + '.join(terms)}))"


_UNITS = f"(SELECT *, a / 255 AS cc, b / 255 AS mm, c / 255 AS yy, d / 255 AS kk FROM (SELECT {_KEYS}, {_BYTES} FROM lineitem))"
_QUANTISED = f"(SELECT *, floor(a / 255 * 65536) / 65536 AS cc, floor(b / 255 * 65536) / 65536 AS mm, floor(c / 255 * 65536) / 65536 AS yy, floor(d / 255 * 65536) / 65536 AS kk FROM (SELECT {_KEYS}, {_BYTES} FROM lineitem))"


@query("cmyk_bytes_to_rgb", f"SELECT {_KEYS}, " + ", ".join(f"CAST(floor({_corner_sql(i)} * 255 + 0.5) AS INTEGER) AS {n}" for i, n in enumerate("rgb")) + f" FROM {_UNITS}")
def cmyk_bytes_to_rgb(spark, folder):
    rgb = color.cmyk_bytes_to_rgb(*_abcd())
    return _bytes(spark, folder).select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in zip("rgb", rgb)])


@query("cmyk_to_rgb", f"SELECT {_KEYS}, " + ", ".join(f"CAST((255 * CAST(floor({_corner_sql(i)} * 65536) AS BIGINT) + 32768) >> 16 AS INTEGER) AS {n}" for i, n in enumerate("rgb")) + f" FROM {_QUANTISED}")
def cmyk_to_rgb(spark, folder):
    rgb = color.cmyk_to_rgb(*[v / 255.0 for v in _abcd()])
    return _bytes(spark, folder).select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in zip("rgb", rgb)])


def _poly_sql(w: tuple) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return f"CAST(greatest(0, least(255, round(({d(w[0])} + cc * {d(w[1])} + mm * {d(w[2])} + yy * {d(w[3])} + kk * {d(w[4])} + cc * kk * {d(w[5])} + mm * kk * {d(w[6])} + yy * kk * {d(w[7])}) * 255))) AS INTEGER)"


@query("cmyk_poly8", f"SELECT {_KEYS}, " + ", ".join(f"{_poly_sql(w)} AS {n}" for n, w in zip("rgb", color.CMYK_POLYNOMIAL)) + f" FROM {_UNITS}")
def cmyk_poly8(spark, folder):
    return _bytes(spark, folder).select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in zip("rgb", color.cmyk_polynomial(*_abcd()))])


_CURVE = "CASE WHEN {t} >= 6.0 / 29 THEN {t} * {t} * {t} ELSE ({t} - 4.0 / 29) * 108 / 841 END"
_LAB = f"""(SELECT {_KEYS}, 0.9505 * ({_CURVE.format(t="(mm + aa / 500)")}) AS x, 1.0 * ({_CURVE.format(t="mm")}) AS y, 1.0888 * ({_CURVE.format(t="(mm - bb / 200)")}) AS z
           FROM (SELECT {_KEYS}, (CAST(l_quantity * 2 AS DOUBLE) + 16) / 116 AS mm, CAST(l_partkey % 201 - 100 AS DOUBLE) AS aa, CAST(l_suppkey * 7 % 201 - 100 AS DOUBLE) AS bb FROM lineitem))"""


@query("lab_to_rgb", f"SELECT {_KEYS}, " + ", ".join(f"CAST(round(least(255.0, sqrt(greatest(x * {r[0]} + y * {r[1]} + z * {r[2]}, 0.0)) * 255)) AS INTEGER) AS {n}" for n, r in zip("rgb", color.XYZ_D65)) + f" FROM {_LAB}")
def lab_to_rgb(spark, folder):
    rgb = color.lab_to_rgb(F.col("l_quantity") * 2, (F.col("l_partkey") % 201 - 100).cast("double"), (F.col("l_suppkey") * 7 % 201 - 100).cast("double"))
    return _line(spark, folder, *[v.alias(n) for n, v in zip("rgb", rgb)])


@query("color_key_mask", f"SELECT {_KEYS}, a BETWEEN 10 AND 200 AND b BETWEEN 0 AND 128 AND c BETWEEN 30 AND 255 AS hidden FROM (SELECT {_KEYS}, {_BYTES} FROM lineitem)")
def color_key_mask(spark, folder):
    return _bytes(spark, folder).select("l_orderkey", "l_linenumber", color.color_key_hidden(F.array("a", "b", "c"), (10, 0, 30), (200, 128, 255)).alias("hidden"))


# --- blends: a, b against c, d as two channels (separable), three for the others ---

_DIV = "((({x}) + (({x}) >> 8) + 128) >> 8)"
_HARD = f"CASE WHEN {{s}} <= 127 THEN {_DIV.format(x='2 * {s} * {d}')} ELSE 2 * {{s}} + 2 * {{d}} - {_DIV.format(x='2 * {s} * {d}')} - 255 END"
_SOFT = """CAST(floor(greatest(0.0, least(1.0, CASE WHEN {s} / 255 <= 0.5 THEN {d} / 255 - (1 - 2 * ({s} / 255)) * ({d} / 255) * (1 - {d} / 255)
    ELSE {d} / 255 + (2 * ({s} / 255) - 1) * (CASE WHEN {d} / 255 <= 0.25 THEN ((16 * ({d} / 255) - 12) * ({d} / 255) + 4) * ({d} / 255) ELSE sqrt({d} / 255) END - {d} / 255) END)) * 255 + 0.5) AS BIGINT)"""
_BLEND_SQL = {
    "normal": "{s}",
    "multiply": "({s} * {d}) // 255",
    "screen": "{s} + {d} - " + _DIV.format(x="{s} * {d}"),
    "overlay": _HARD.replace("{s}", "{q}").replace("{d}", "{s}").replace("{q}", "{d}"),
    "darken": "least({s}, {d})",
    "lighten": "greatest({s}, {d})",
    "color_dodge": "CASE WHEN {s} = 255 THEN 255 ELSE least(255, ({d} * 255) // greatest(255 - {s}, 1)) END",
    "color_burn": "CASE WHEN {s} = 0 THEN 0 ELSE 255 - least(255, ((255 - {d}) * 255) // greatest({s}, 1)) END",
    "hard_light": _HARD,
    "soft_light": _SOFT,
    "difference": "abs({s} - {d})",
    "exclusion": "{s} + {d} - 2 * " + _DIV.format(x="{s} * {d}"),
}


def _separable(mode: str):
    def build(spark, folder):
        out = color.blend(mode, (F.col("a"), F.col("b")), (F.col("c"), F.col("d")))
        return _bytes(spark, folder).select("l_orderkey", "l_linenumber", out[0].alias("u"), out[1].alias("v"))

    return build


for _mode, _sql in _BLEND_SQL.items():
    _two = [_sql.replace("{s}", s).replace("{d}", d) for s, d in (("a", "c"), ("b", "d"))]
    query(f"blend_{_mode}", f"SELECT {_KEYS}, CAST({_two[0]} AS INTEGER) AS u, CAST({_two[1]} AS INTEGER) AS v FROM (SELECT {_KEYS}, {_BYTES} FROM lineitem)")(_separable(_mode))


def _non_separable(mode: str):
    def build(spark, folder):
        out = color.blend(mode, (F.col("a"), F.col("b"), F.col("c")), (F.col("d"), F.col("a"), F.col("b")))
        return _bytes(spark, folder).select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in zip("rgb", out)])

    return build


def _non_separable_sql(mode: str) -> str:
    """The same in steps, one nested select each: r, g, b is the colour in work, s the source, d the backdrop."""
    lum = "(0.3::DOUBLE * {0} + 0.59::DOUBLE * {1} + 0.11::DOUBLE * {2})"
    of = lambda p: lum.format(*(f"{p}{i}" for i in "123"))
    low, high = (lambda p: f"least({p}1, {p}2, {p}3)"), (lambda p: f"greatest({p}1, {p}2, {p}3)")
    keys = f"{_KEYS}, s1, s2, s3, d1, d2, d3"
    step = f"SELECT {_KEYS}, a / 255 AS s1, b / 255 AS s2, c / 255 AS s3, d / 255 AS d1, a / 255 AS d2, b / 255 AS d3 FROM (SELECT {_KEYS}, {_BYTES} FROM lineitem)"
    colour, spread, level = {"hue": ("s", "d", "d"), "saturation": ("d", "s", "d"), "color": ("s", None, "d"), "luminosity": ("d", None, "s")}[mode]
    if spread:
        span = f"({high(colour)} - {low(colour)})"
        step = f"SELECT {keys}, " + ", ".join(f"CASE WHEN {span} > 0 THEN ({colour}{i} - {low(colour)}) * ({high(spread)} - {low(spread)}) / {span} ELSE 0 END AS r{i}" for i in "123") + f" FROM ({step})"
    else:
        step = f"SELECT {keys}, {colour}1 AS r1, {colour}2 AS r2, {colour}3 AS r3 FROM ({step})"
    step = f"SELECT {keys}, " + ", ".join(f"r{i} + ({of(level)} - {of('r')}) AS r{i}" for i in "123") + f" FROM ({step})"
    step = f"SELECT {_KEYS}, r1, r2, r3, {of('r')} AS l, {low('r')} AS lo, {high('r')} AS hi FROM ({step})"
    step = f"SELECT {_KEYS}, l, hi, " + ", ".join(f"CASE WHEN lo < 0 THEN CASE WHEN l = lo THEN l ELSE l + (r{i} - l) * l / (l - lo) END ELSE r{i} END AS r{i}" for i in "123") + f" FROM ({step})"
    step = f"SELECT {_KEYS}, " + ", ".join(f"CASE WHEN hi > 1 THEN CASE WHEN hi = l THEN l ELSE l + (r{i} - l) * (1 - l) / (hi - l) END ELSE r{i} END AS r{i}" for i in "123") + f" FROM ({step})"
    return f"SELECT {_KEYS}, " + ", ".join(f"CAST(floor(round(greatest(0.0, least(1.0, r{i})) * 255, 6) + 0.5) AS INTEGER) AS {n}" for i, n in zip("123", "rgb")) + f" FROM ({step})"


for _mode in color.NON_SEPARABLE:
    query(f"blend_{_mode}", _non_separable_sql(_mode))(_non_separable(_mode))


# --- pixels: a line is a pixel with two images' channels ---

_PIXELS = f"(SELECT l_partkey % 640 AS x, l_suppkey * 13 % 480 AS y, a, b, c, CASE WHEN l_linenumber <= 3 THEN a ELSE (a + l_linenumber) % 256 END AS a2, b AS b2, CASE WHEN l_linenumber = 6 THEN d ELSE c END AS c2 FROM (SELECT *, {_BYTES} FROM lineitem))"


def _pixels(spark, folder):
    line = read_table(spark, folder, "lineitem")
    a, b, c = (F.col("l_partkey") * 37 % 256), (F.col("l_suppkey") * 91 % 256), (F.col("l_orderkey") % 256)
    d, n = (F.col("l_linenumber") * 40 + F.col("l_quantity").cast("bigint")) % 256, F.col("l_linenumber")
    return line.select((F.col("l_partkey") % 640).alias("x"), (F.col("l_suppkey") * 13 % 480).alias("y"), a.alias("a"), b.alias("b"), c.alias("c"), F.when(n <= 3, a).otherwise((a + n) % 256).alias("a2"), b.alias("b2"), F.when(n == 6, d).otherwise(c).alias("c2"))


_DIFFERS = "(a <> a2 OR b <> b2 OR c <> c2)"


@query(
    "pixel_metrics",
    f"""SELECT total, matched, abs_delta, round(100.0 * matched / total, 6) AS exact_percent, round(greatest(0.0, 100 - 100.0 * abs_delta / (total * 765)), 6) AS similarity_percent
        FROM (SELECT count(*) AS total, count(*) FILTER (NOT {_DIFFERS}) AS matched, CAST(sum(abs(a - a2) + abs(b - b2) + abs(c - c2)) AS BIGINT) AS abs_delta FROM {_PIXELS})""",
)
def pixel_metrics(spark, folder):
    out = P.metrics(_pixels(spark, folder), ("a", "b", "c"), ("a2", "b2", "c2"))
    return out.select("total", "matched", "abs_delta", F.round("exact_percent", 6).alias("exact_percent"), F.round("similarity_percent", 6).alias("similarity_percent"))


@query("diff_bbox", f"SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM {_PIXELS} WHERE {_DIFFERS}")
def diff_bbox(spark, folder):
    return P.bounding_box(_pixels(spark, folder), F.expr(_DIFFERS))


@query("tile_histogram", f"SELECT CAST(x // 48 AS BIGINT) AS tile_x, CAST(y // 48 AS BIGINT) AS tile_y, count(*) AS n FROM {_PIXELS} WHERE {_DIFFERS} GROUP BY 1, 2")
def tile_histogram(spark, folder):
    return P.tiles(_pixels(spark, folder), F.expr(_DIFFERS))


@query("color_histogram_top10", f"SELECT r, g, b, count(*) AS n FROM (SELECT a // 64 AS r, b // 64 AS g, c // 64 AS b FROM {_PIXELS}) GROUP BY r, g, b ORDER BY n DESC, r, g, b LIMIT 10")
def color_histogram_top10(spark, folder):
    coarse = _pixels(spark, folder).select(*[F.floor(F.col(c) / 64).alias(n) for c, n in zip("abc", "rgb")])
    return P.color_histogram(coarse, "r", "g", "b")


@query("xor_amplified", f"SELECT {_KEYS}, CAST(CASE WHEN a = c THEN 0 ELSE 64 + (xor(a, c) * 191) // 255 END AS INTEGER) AS v FROM (SELECT {_KEYS}, {_BYTES} FROM lineitem)")
def xor_amplified(spark, folder):
    return _bytes(spark, folder).select("l_orderkey", "l_linenumber", P.amplified_xor(F.col("a"), F.col("c")).alias("v"))


# --- scalars ---


@query("points_to_pixels", "SELECT p_partkey, CAST(greatest(ceil(abs(p_retailprice) * (150 / 72.0::DOUBLE) - 1e-9), 1) AS BIGINT) AS pixels FROM part")
def points_to_pixels(spark, folder):
    return read_table(spark, folder, "part").select("p_partkey", numeric.points_to_pixels(F.col("p_retailprice"), 150).alias("pixels"))


_ANGLE = "((p_partkey * 45 - 400) % 360 + 360) % 360"


@query("rotation_normalize", f"SELECT p_partkey, CAST(CASE WHEN {_ANGLE} IN (90, 180, 270) THEN {_ANGLE} ELSE 0 END AS BIGINT) AS exact, CAST(CASE WHEN {_ANGLE} < 45 THEN 0 WHEN {_ANGLE} < 135 THEN 90 WHEN {_ANGLE} < 225 THEN 180 WHEN {_ANGLE} < 315 THEN 270 ELSE 0 END AS BIGINT) AS nearest FROM part")
def rotation_normalize(spark, folder):
    angle = F.col("p_partkey") * 45 - 400
    return read_table(spark, folder, "part").select("p_partkey", numeric.rotation_exact(angle).cast("bigint").alias("exact"), numeric.rotation_nearest(angle).cast("bigint").alias("nearest"))


@query("worker_budget", "SELECT p_partkey, CAST(CASE WHEN p_size % 9 = 0 THEN w ELSE greatest(1, least(w, 1000 // (p_size % 9 * 90))) END AS BIGINT) AS workers FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN 4 ELSE p_size % 5 END AS w FROM part)")
def worker_budget(spark, folder):
    return read_table(spark, folder, "part").select("p_partkey", numeric.worker_budget(F.col("p_size") % 5, F.lit(1000), F.col("p_size") % 9 * 90).alias("workers"))


@query("permission_bits", "SELECT p_partkey, (p_partkey & 12) <> 0 AS may_copy, (p_partkey & 4) <> 0 AS may_print FROM part")
def permission_bits(spark, folder):
    return read_table(spark, folder, "part").select("p_partkey", numeric.has_permission(F.col("p_partkey"), 12).alias("may_copy"), numeric.has_permission(F.col("p_partkey"), 4).alias("may_print"))


_ROMAN_SQL = "concat(repeat('M', CAST(n // 1000 AS INTEGER)), " + ", ".join("[" + ", ".join(f"'{d}'" for d in T.ROMAN[p]) + f"][CAST(n // {10**p} % 10 AS INTEGER) + 1]" for p in (2, 1, 0)) + ")"


@query("roman_numerals", f"SELECT p_partkey, {_ROMAN_SQL} AS roman FROM (SELECT p_partkey, p_partkey % 5000 + 1 AS n FROM part)")
def roman_numerals(spark, folder):
    return read_table(spark, folder, "part").select("p_partkey", T.roman(F.col("p_partkey") % 5000 + 1).alias("roman"))


_ALPHA = "CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN concat(chr(CAST(64 + (n - 1) // 26 AS INTEGER)), chr(CAST(65 + (n - 1) % 26 AS INTEGER))) ELSE concat(chr(CAST(64 + (n - 27) // 676 AS INTEGER)), chr(CAST(65 + (n - 27) // 26 % 26 AS INTEGER)), chr(CAST(65 + (n - 1) % 26 AS INTEGER))) END"


@query("alpha_labels", f"SELECT p_partkey, {_ALPHA} AS label FROM (SELECT p_partkey, p_partkey % 3000 + 1 AS n FROM part)")
def alpha_labels(spark, folder):
    return read_table(spark, folder, "part").select("p_partkey", T.alphabetic(F.col("p_partkey") % 3000 + 1).alias("label"))


_RANGES = "(VALUES (0, '', 'r', 1), (10, '', 'D', 1), (60, 'A-', 'A', 5), (120, 'Cover', '', 1)) AS r(first, prefix, style, number)"
_LABELLED = f"""(SELECT page, prefix, style, greatest(number + page - first, 1) AS n FROM (SELECT DISTINCT p_partkey AS page FROM part)
                ASOF JOIN {_RANGES} ON page >= first)"""
_LABEL = f"concat(prefix, CASE style WHEN 'D' THEN CAST(n AS VARCHAR) WHEN 'r' THEN lower({_ROMAN_SQL}) WHEN 'A' THEN {_ALPHA} ELSE '' END)"


def _labels(spark, folder):
    """Pages take the last label range that starts at or before them.

    Ranges are few: each page counts those that start by then, and reads the last of them from a literal list.
    """
    ranges = [(0, "", "r", 1), (10, "", "D", 1), (60, "A-", "A", 5), (120, "Cover", "", 1)]
    pages = read_table(spark, folder, "part").select(F.col("p_partkey").alias("page")).distinct()
    listed = F.array(*[F.struct(F.lit(first).alias("first"), F.lit(prefix).alias("prefix"), F.lit(style).alias("style"), F.lit(number).alias("number")) for first, prefix, style, number in ranges])
    found = pages.withColumn("r", F.get(listed, numeric.segment(F.col("page"), [r[0] for r in ranges]) - 1)).where("r is not null")
    return found.select("page", T.page_label(F.col("r.prefix"), F.col("r.style"), F.col("r.number"), F.col("page") - F.col("r.first")).alias("label"))


@query("page_labels", f"SELECT page, {_LABEL} AS label FROM {_LABELLED}")
def page_labels(spark, folder):
    return _labels(spark, folder)


@query("label_to_page", f"SELECT label, min(page) + 1 AS page_number FROM (SELECT page, {_LABEL} AS label FROM {_LABELLED}) WHERE trim(label) <> '' GROUP BY label")
def label_to_page(spark, folder):
    return _labels(spark, folder).where(F.trim("label") != "").groupBy("label").agg((F.min("page") + 1).alias("page_number"))


@query(
    "page_spec_expand",
    """SELECT p_partkey, CAST(page AS INTEGER) AS page FROM (
           SELECT p_partkey, unnest(list_concat(range(p_size, p_size + 4), [CAST(7 AS BIGINT), CAST(7 AS BIGINT)])) AS page FROM part)""",
)
def page_spec_expand(spark, folder):
    spec = F.format_string("%d-%d, 7,,7", F.col("p_size"), F.col("p_size") + 3)
    return read_table(spark, folder, "part").select("p_partkey", F.explode(page_spec(spec)).alias("page"))


@query(
    "pdf_dates",
    """SELECT o_orderkey, o_orderdate - CASE WHEN o_orderkey % 3 = 0 THEN to_minutes(90) WHEN o_orderkey % 3 = 1 THEN to_minutes(-300) ELSE to_minutes(0) END AS at
       FROM (SELECT o_orderkey, date_trunc('second', o_orderdate) AS o_orderdate FROM orders)""",
)
def pdf_dates(spark, folder):
    zone = F.when(F.col("o_orderkey") % 3 == 0, F.lit("+01'30'")).when(F.col("o_orderkey") % 3 == 1, F.lit("-05'00")).otherwise(F.lit("Z"))
    text = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), zone)
    return read_table(spark, folder, "orders").select("o_orderkey", numeric.pdf_date(text).cast("timestamp_ntz").alias("at"))


@query("durations", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 1.0::DOUBLE WHEN 1 THEN p_size * 1000.0::DOUBLE ELSE p_size / 1000.0::DOUBLE END AS ms FROM part")
def durations(spark, folder):
    unit = F.when(F.col("p_partkey") % 3 == 0, F.lit("ms")).when(F.col("p_partkey") % 3 == 1, F.lit("s")).otherwise(F.lit("us"))
    return read_table(spark, folder, "part").select("p_partkey", numeric.duration_ms(F.concat(F.col("p_size").cast("string"), unit)).alias("ms"))


@query("affine_apply", "SELECT p_partkey, CAST(2 * p_size + 10 AS BIGINT) AS x, 3 * (p_partkey % 50) - 6 AS y FROM part")
def affine_apply(spark, folder):
    one = [F.lit(v) for v in (2, 0, 0, 3, 0, 0)]
    two = [F.lit(v) for v in (1, 0, 0, 1, 10, -6)]
    x, y = numeric.apply_matrix(numeric.matrix_multiply(one, two), F.col("p_size"), F.col("p_partkey") % 50)
    return read_table(spark, folder, "part").select("p_partkey", x.cast("bigint").alias("x"), y.alias("y"))


@query("byte_range_digest", "SELECT doc_id, sha256(concat(substr(lang, 1, 1), source, substr(lang, 2))) AS digest FROM documents")
def byte_range_digest(spark, folder):
    """Digest over the two ranges around a signature's place."""
    return read_table(spark, folder, "documents").select("doc_id", F.sha2(F.concat(F.substring("lang", 1, 1), "source", F.substring("lang", 2, 100)), 256).alias("digest"))
