"""Text reports: compare CSV, floors TSV, manifests, object headers, markup and form data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPARE_SCHEMA = "pdf string, page string, exact_percent string, similarity_percent string, total_pixels string, diff_pixels string, avg_diff string, pass string, error string"
FLOOR_SCHEMA = "pdf_basename string, page int, similarity_floor double, exact_percent_floor double, captured_phase string"


def number(column: Column, kind: str) -> Column:
    """Blank or malformed fields count as 0."""
    return F.coalesce(F.trim(column).try_cast(kind), F.lit(0).cast(kind))


def read_compare_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-keyed compare rows; rows without a positive page are left out."""
    raw = spark.read.csv(path, header=True, schema=COMPARE_SCHEMA)
    typed = raw.select(
        "pdf",
        number(F.col("page"), "int").alias("page"),
        *[number(F.col(c), "double").alias(c) for c in ("exact_percent", "similarity_percent", "avg_diff")],
        *[number(F.col(c), "bigint").alias(c) for c in ("total_pixels", "diff_pixels")],
        F.coalesce(F.lower(F.trim("pass")) == "true", F.lit(False)).alias("pass"),
        F.coalesce("error", F.lit("")).alias("error"),
    )
    return typed.where("page > 0")


def read_floors(spark: SparkSession, path: str) -> DataFrame:
    """Tab separated floors; ``#`` starts a comment line."""
    return spark.read.csv(path, sep="\t", comment="#", schema=FLOOR_SCHEMA)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Four tab separated columns; lines that begin with ``# TODO`` are data, other comments are not."""
    lines = spark.read.text(path).where((F.trim("value") != "") & (~F.col("value").startswith("#") | F.col("value").startswith("# TODO")))
    parts = F.split("value", "\t")
    todo = F.col("value").startswith("# TODO")
    names = ("fixture", "primitive", "bytes", "sha256")
    return lines.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)], todo.alias("todo")).withColumn("bytes", F.col("bytes").try_cast("bigint"))


def page_spec(spec: Column) -> Column:
    """``"1-3,5"`` as an array of page numbers: order and repeats are kept.

    An inverted range, a page below 1 or anything else that is no number raises.
    """
    def bad(part: Column) -> Column:
        return F.raise_error(F.concat(F.lit("invalid page range: "), part))

    def pages(part: Column) -> Column:
        a = F.regexp_extract(part, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 1).try_cast("int")
        b = F.regexp_extract(part, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 2).try_cast("int")
        end = F.coalesce(b, a)
        return F.when(a.isNull() | (a < 1) | (a > end), F.array(bad(part).cast("int"))).otherwise(F.sequence(a, end))

    parts = F.filter(F.split(spec, ","), lambda p: F.trim(p) != "")
    return F.flatten(F.transform(parts, pages))


def object_headers(text: Column) -> Column:
    """Recovery scan: every ``num gen obj`` header of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+\s+\d+\s+obj)\b"), 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).try_cast("bigint").alias("num"), F.regexp_extract(x, r"^\d+\s+(\d+)", 1).try_cast("int").alias("gen")))


def latest_entries(entries: DataFrame, key: list[str], generation: str) -> DataFrame:
    """Cross-reference sections: the newest entry of each key wins."""
    by = Window.partitionBy(*key).orderBy(F.desc(generation))
    return entries.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def resolve_entities(text: Column) -> Column:
    """Named XML entities; ``&amp;`` is resolved before the quotes, as a later pass sees its result."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def resolve_numeric_entities(text: Column) -> Column:
    """``&#xHH;`` and ``&#DD;``: the text between references and the references, joined again."""
    pieces = F.split(text, r"(?=&#(?:x[0-9a-fA-F]+|\d+);)|(?<=;)")

    def one(p: Column) -> Column:
        code = F.coalesce(F.conv(F.nullif(F.regexp_extract(p, r"^&#x([0-9a-fA-F]{1,6});$", 1), F.lit("")), 16, 10).try_cast("int"), F.nullif(F.regexp_extract(p, r"^&#(\d{1,7});$", 1), F.lit("")).try_cast("int"))
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), wide).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def form_fields_xfdf(xml: Column) -> Column:
    """Form data: (dotted name, values) of every field that has a value, at up to two levels."""
    block = F.regexp_extract_all(xml, F.lit(r"(?s)(<field\s+name=\"[^\"]*\"[^>]*>\s*(?:<value>.*?</value>\s*)+)"), 1)
    return F.transform(block, lambda b: F.struct(F.regexp_extract(b, r'name="([^"]*)"', 1).alias("name"), F.regexp_extract_all(b, F.lit(r"(?s)<value>(.*?)</value>"), 1).alias("values")))


#: Properties that are lists.
LISTS = ("dc:creator", "dc:subject")


def rdf_properties(xml: Column) -> Column:
    """map<name, array of values> of the properties of all descriptions; names in lower case, a later one of a name wins.

    Lists give their items, other properties their trimmed text, entities resolved.
    """
    body = F.array_join(F.regexp_extract_all(xml, F.lit(r"(?is)<rdf:Description\b[^>/]*>(.*?)</rdf:Description>"), 1), "")
    entries = F.regexp_extract_all(body, F.lit(r"(?s)(<([A-Za-z][\w:.-]*)\b[^>]*>.*?</\2>)"), 1)

    def plain(x: Column) -> Column:
        return F.regexp_replace(resolve_entities(F.regexp_replace(x, r"(?s)<[^>]*>", "")), r"^\s+|\s+$", "")

    def value(entry: Column) -> Column:
        items = F.transform(F.regexp_extract_all(entry["e"], F.lit(r"(?is)<rdf:li\b[^>]*>(.*?)</rdf:li>"), 1), plain)
        return F.struct(entry["key"].alias("key"), F.when(entry["key"].isin(*LISTS), items).otherwise(F.array(plain(entry["e"]))).alias("value"))

    # each step is bound to the argument of a function: what stands free in one is computed again for each entry
    named = F.transform(entries, lambda e: F.struct(F.lower(F.regexp_extract(e, r"^<([A-Za-z][\w:.-]*)", 1)).alias("key"), e.alias("e")))
    keyed = F.transform(F.array(named), lambda n: F.struct(n.alias("n"), F.transform(n, lambda x: x["key"]).alias("keys")))
    last = F.transform(keyed, lambda k: F.filter(k["n"], lambda x, i: F.array_position(F.slice(k["keys"], i + 2, F.size(k["keys"])), x["key"]) == 0))[0]
    return F.map_from_entries(F.transform(last, value))


def annotations(rows: DataFrame, identity: str | None = None, kind: str | None = None, id_column: str = "id", kind_column: str = "kind") -> DataFrame:
    """Annotations of an id or a type, or both."""
    out = rows if identity is None else rows.where(F.col(id_column) == identity)
    return out if kind is None else out.where(F.col(kind_column) == kind)
