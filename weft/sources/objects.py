"""Objects of a document: lookups by number, packed streams of objects, code maps and form data in object syntax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.reports import latest_entries

HEX = r"<([0-9A-Fa-f]*)>"


def fetch(asked: DataFrame, entries: DataFrame, found: DataFrame, key: Sequence[str], place: str, generation: str) -> DataFrame:
    """``asked`` with the ``place`` of each object: that of its newest entry, else where a scan has found it."""
    newest = latest_entries(entries, list(key), generation).select(*key, F.col(place).alias("_listed"))
    scanned = found.groupBy(*key).agg(F.max(place).alias("_scanned"))
    joined = asked.join(newest, list(key), "left").join(scanned, list(key), "left")
    return joined.withColumn(place, F.coalesce("_listed", "_scanned")).drop("_listed", "_scanned")


def dereference(values: DataFrame, objects: DataFrame, ref: str, value: str) -> DataFrame:
    """``values`` with ``value`` of the object that ``ref`` names; a reference to nothing stays as it is."""
    known = objects.select(F.col(ref), F.col(value).alias("_value"))
    return values.join(known, ref, "left").withColumn(value, F.coalesce(F.col("_value"), F.col(ref).cast("string"))).drop("_value")


def object_stream(data: Column, count: Column, first: Column) -> Column:
    """array<struct<num, body>> of a packed stream: ``count`` pairs of number and offset, bodies from byte ``first`` on.

    A body ends where the next one, in the order of the header, begins.  Stream, header and counts are bound once:
    what stands free in the function of a transform is computed again for each object.
    """
    header = F.regexp_extract_all(F.substring(data, F.lit(1), first).cast("string"), F.lit(r"(-?\d+|null)"), 1)
    bound = F.struct(data.alias("data"), header.alias("header"), count.cast("int").alias("count"), first.cast("int").alias("first"))

    def read(s: Column) -> Column:
        at = lambda i: F.get(s["header"], i * 2 + 1).cast("int") + s["first"]
        end = lambda i: F.when(i + 1 < s["count"], at(i + 1)).otherwise(F.length(s["data"]))
        places = F.when(s["count"] > 0, F.sequence(F.lit(0), s["count"] - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.get(s["header"], i * 2).try_cast("bigint").alias("num"), F.substring(s["data"], at(i) + 1, end(i) - at(i)).alias("body")))

    return F.transform(F.array(bound), read)[0]


# --- code maps ---


def _bytes(digits: Column) -> Column:
    """An odd number of hexadecimal digits is padded with 0."""
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, F.lit("0")).otherwise(F.lit(""))))


def _unicode(raw: Column) -> Column:
    """UTF-16 if the number of bytes is even, else UTF-8 if valid, else one character a byte."""
    return F.when(F.length(raw) % 2 == 0, F.decode(raw, "UTF-16BE")).when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def _raised(raw: Column, by: Column) -> Column:
    """The text of a range's code: the last unit of its first text, raised."""
    n = F.length(raw)
    unit = F.conv(F.hex(F.substring(raw, n - 1, F.lit(2))), 16, 10).cast("bigint")
    pair = F.concat(F.substring(raw, F.lit(1), n - 2), F.unhex(F.lpad(F.hex(F.pmod(unit + by, F.lit(65536))), 4, "0")))
    single = F.decode(F.unhex(F.lpad(F.hex(F.conv(F.hex(raw), 16, 10).cast("bigint") + by), 8, "0")), "UTF-32")
    return F.when(n == 0, F.lit("")).when(n % 2 == 0, F.decode(pair, "UTF-16BE")).when(n <= 4, single).otherwise(_unicode(raw))


def code_map(fonts: DataFrame, key: str, cmap: str) -> DataFrame:
    """(key, code, text): what each code, as upper-case hexadecimal digits, stands for; a later line of a map wins.

    Single codes, ranges with a first text and ranges with a list of texts.
    """
    body = fonts.select(key, F.regexp_replace(cmap, r"%[^\r\n]*", "").alias("_m"))
    sections = body.select(key, F.posexplode(F.regexp_extract_all("_m", F.lit(r"(?s)(beginbf(?:char|range).*?endbf(?:char|range))"), 1)).alias("_section", "_s"))
    single = rf"{HEX}\s*{HEX}"
    chars = sections.where(F.col("_s").startswith("beginbfchar")).select(key, "_section", F.posexplode(F.regexp_extract_all("_s", F.lit(f"({single})"), 1)).alias("_line", "_l"))
    one = chars.select(key, "_section", "_line", F.hex(_bytes(F.regexp_extract("_l", single, 1))).alias("code"), _unicode(_bytes(F.regexp_extract("_l", single, 2))).alias("text"))
    several = rf"{HEX}\s*{HEX}\s*({HEX}|\[[^\]]*\])"
    ranges = sections.where(F.col("_s").startswith("beginbfrange")).select(key, "_section", F.posexplode(F.regexp_extract_all("_s", F.lit(f"({several})"), 1)).alias("_line", "_l"))
    number = lambda i: F.conv(F.hex(_bytes(F.regexp_extract("_l", several, i))), 16, 10).cast("bigint")
    bounds = ranges.select(key, "_section", "_line", number(1).alias("lo"), number(2).alias("hi"), F.length(_bytes(F.regexp_extract("_l", several, 1))).alias("width"), F.regexp_extract("_l", several, 3).alias("to"))
    codes = bounds.where("lo <= hi and width between 1 and 4").select("*", F.explode(F.sequence("lo", "hi")).alias("n"))
    step = (F.col("n") - F.col("lo")).cast("int")
    listed = F.get(F.regexp_extract_all("to", F.lit(HEX), 1), step)
    text = F.when(F.col("to").startswith("["), _unicode(_bytes(listed))).otherwise(_raised(_bytes(F.regexp_extract("to", HEX, 1)), step))
    many = codes.select(key, "_section", "_line", F.lpad(F.hex("n"), F.col("width") * 2, F.lit("0")).alias("code"), text.alias("text")).where("text is not null")
    by = Window.partitionBy(key, "code").orderBy(F.desc("_section"), F.desc("_line"))
    return one.unionByName(many).withColumn("_r", F.row_number().over(by)).where("_r = 1").select(key, "code", "text")


# --- form data in object syntax ---

#: Characters that stand escaped in a literal string, and their escapes (the backslash comes first).
ESCAPES = (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_LITERAL = r"\(((?:[^()\\]|\\.)*)\)"


def literal_string(text: Column) -> Column:
    for char, escape in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(escape))
    return F.concat(F.lit("("), text, F.lit(")"))


def unescaped(text: Column) -> Column:
    """The value of a literal string's inside: escapes are taken one by one, from the left."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\\.|[^\\]+)"), 1)

    def one(p: Column) -> Column:
        out = F.when(~p.startswith("\\"), p)
        for char, escape in ESCAPES:
            out = out.when(p == escape, F.lit(char))
        return out.otherwise(F.substring(p, 2, 8))

    return F.array_join(F.transform(pieces, one), "")


def form_data_objects(fields: DataFrame, form: str, name: str, values: str) -> DataFrame:
    """(form, data): each form's fields (name, array of values) as an object file with a cross-reference table.

    Fields stand in order of their names; a field without values has one empty value.  A form is a bounded group.
    """
    listed = F.transform(F.when(F.size(values) > 0, F.col(values)).otherwise(F.array(F.lit(""))), literal_string)
    value = F.when(F.size(listed) == 1, listed[0]).otherwise(F.concat(F.lit("["), F.array_join(listed, " "), F.lit("]")))
    item = F.concat(F.lit("<< /T "), literal_string(F.col(name)), F.lit(" /V "), value, F.lit(" >>"))
    # numbers and places are added up by a window: an array that an aggregate appends to is copied for each field
    by = Window.partitionBy(form).orderBy("_name", "_item")
    items = fields.select(form, F.col(name).alias("_name"), item.alias("_item")).withColumn("_number", F.row_number().over(by) + 1)
    object_text = lambda number, x: F.concat(number.cast("string"), F.lit(" 0 obj\n"), x, F.lit("\nendobj\n"))
    written = items.withColumn("_body", object_text(F.col("_number"), F.col("_item")))
    placed = written.withColumn("_at", F.sum(F.octet_length("_body")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    forms = placed.groupBy(form).agg(F.array_sort(F.collect_list(F.struct("_number", "_at", "_body"))).alias("_items"))
    refs = F.array_join(F.transform("_items", lambda x: F.concat(x["_number"].cast("string"), F.lit(" 0 R"))), " ")
    root = object_text(F.lit(1), F.concat(F.lit("<< /Type /Catalog /FDF << /Fields ["), refs, F.lit("] >> >>")))
    head = F.concat(F.lit("%FDF-1.2\n%").cast("binary"), F.unhex(F.lit("E2E3CFD3")), F.lit("\n").cast("binary"))
    rooted = forms.withColumn("_root", root).withColumn("_first", F.length(head) + F.octet_length("_root"))
    # one place for each object and one for the table behind them
    places = F.concat(F.array(F.length(head).cast("bigint"), F.col("_first").cast("bigint")), F.transform("_items", lambda x: F.col("_first") + x["_at"]))
    made = rooted.withColumn("_bodies", F.concat(F.array("_root"), F.transform("_items", lambda x: x["_body"]))).withColumn("_starts", places)
    n = F.size("_bodies")
    rows = F.array_join(F.transform(F.slice("_starts", F.lit(1), n), lambda s: F.concat(F.lpad(s.cast("string"), 10, "0"), F.lit(" 00000 n \n"))), "")
    tail = F.concat(F.lit("xref\n0 "), (n + 1).cast("string"), F.lit("\n0000000000 65535 f \n"), rows, F.lit("trailer\n<< /Root 1 0 R /Size "), (n + 1).cast("string"), F.lit(" >>\nstartxref\n"), F.element_at("_starts", -1).cast("string"), F.lit("\n%%EOF\n"))
    return made.select(form, F.concat(head, F.array_join("_bodies", "").cast("binary"), tail.cast("binary")).alias("data"))


def form_data_fields(text: Column) -> Column:
    """array<struct<name, values>> of the fields of such a file that have a value."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(/T\s*{_LITERAL}\s*/V\s*(?:{_LITERAL}|\[(?:\s*{_LITERAL})*\s*\]))"), 1)
    name = lambda f: unescaped(F.regexp_extract(f, rf"(?s)^/T\s*{_LITERAL}", 1))
    rest = lambda f: F.regexp_replace(f, rf"(?s)^/T\s*{_LITERAL}\s*/V", "")
    return F.transform(found, lambda f: F.struct(name(f).alias("name"), F.transform(F.regexp_extract_all(rest(f), F.lit(f"(?s){_LITERAL}"), 1), unescaped).alias("values")))
