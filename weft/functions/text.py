"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters of counting and of whole-word matching, and Unicode white space.
WORD_RUN = r"[\p{L}\p{Nd}_']+"
WORD_CHAR = r"[\p{L}\p{N}_]"
SPACES = r"[\p{Z}\t\n\x{0B}\f\r\x{85}]+"
CONTEXT = 20


def quoted(literal: str) -> str:
    """A regular expression that matches ``literal``."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def fold(text: Column) -> Column:
    """Lower case rune by rune, so that offsets still index the original text."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def fold_literal(text: str) -> str:
    return text.translate({0x130: "i", 0x3A3: "σ"}).lower()


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RUN))


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def printable_ratio(text: Column) -> Column:
    """Share of characters that print (of spaces only U+0020 does); null for blank text."""
    s = F.trim(text)
    return F.try_divide(F.length(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]|\x{FFFD}", "")), F.length(s))


def is_garbled(text: Column) -> Column:
    return F.coalesce(printable_ratio(text) < 0.8, F.lit(True))


def text_range(text: Column, start: int, end: int) -> Column:
    """Characters [start, end), clamped to the text; an inverted range is an error."""
    if start > end:
        raise ValueError(f"inverted range ({start}, {end})")
    lo = max(start, 0)
    return F.substring(text, lo + 1, max(end, 0) - lo)


def context(text: Column, start: Column, end: Column, width: int = CONTEXT) -> Column:
    """Snippet around [start, end), with ``...`` on a side that is cut."""
    lo, hi = F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text))
    body = F.substring(text, lo + 1, hi - lo)
    return normalize_whitespace(F.concat(F.when(lo > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(hi < F.length(text), F.lit("...")).otherwise(F.lit(""))))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\r\n]+", " "))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def base_font_name(name: Column) -> Column:
    """Without a subset prefix (six capitals and a plus)."""
    return F.regexp_replace(F.regexp_replace(name, r"^/", ""), r"^[A-Z]{6}\+", "")


#: Glyph names of the ASCII characters that are no letters, in order of their codes; a letter is its own name.
GLYPHS = (
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at "
    "bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde"
).split()
_GLYPH_CODES = [*range(32, 65), *range(91, 97), *range(123, 127)]


def glyph_text(name: Column) -> Column:
    """The character of a glyph name: a name of ASCII, ``uniXXXX`` or ``uXXXX`` to ``uXXXXXX``; a suffix behind a dot is left out; null for others."""
    base = F.regexp_replace(name, r"(?<=.)\..*$", "")
    known = F.create_map(*[F.lit(x) for n, c in zip(GLYPHS, _GLYPH_CODES) for x in (n, chr(c))], F.lit("quoteright"), F.lit("'"))
    digits = F.coalesce(F.nullif(F.regexp_extract(base, r"^uni([0-9A-F]{4})$", 1), F.lit("")), F.nullif(F.regexp_extract(base, r"^u([0-9A-F]{4,6})$", 1), F.lit("")))
    code = F.conv(digits, 16, 10).cast("int")
    wide = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
    return F.nullif(map_symbols(F.coalesce(F.when(base.rlike("^[A-Za-z]$"), base), F.try_element_at(known, base), wide)), F.lit(""))


def decode_text(raw: Column) -> Column:
    """UTF-16 with a byte order mark, else UTF-8 if valid, else one character a byte."""
    return F.when(F.hex(F.substring(raw, 1, 2)) == "FEFF", F.decode(F.substring(raw, 3, 1 << 30), "UTF-16BE")).when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def hex_bytes(token: Column) -> Column:
    """Hexadecimal token as bytes; an odd one is padded with 0."""
    digits = F.regexp_replace(token, r"[<>\s]", "")
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, F.lit("0")).otherwise(F.lit(""))))


#: Private-use code points of symbol fonts and the characters that they stand for.
SYMBOLS = {
    0xF6D9: 0x00A9, 0xF6DA: 0x00AE, 0xF6DB: 0x2122, 0xF8E8: 0x00AE, 0xF8E9: 0x00A9, 0xF8EA: 0x2122, 0xF8EB: 0x239B, 0xF8EC: 0x239C,
    0xF8ED: 0x239D, 0xF8EE: 0x23A1, 0xF8EF: 0x23A2, 0xF8F0: 0x23A3, 0xF8F1: 0x23A7, 0xF8F2: 0x23A8, 0xF8F3: 0x23A9, 0xF8F6: 0x239E,
    0xF8F7: 0x239F, 0xF8F8: 0x23A0, 0xF8F9: 0x23A4, 0xF8FA: 0x23A5, 0xF8FB: 0x23A6, 0xF8FC: 0x23AB, 0xF8FD: 0x23AC, 0xF8FE: 0x23AD,
}


def map_symbols(text: Column) -> Column:
    """Symbols of the private use area as common characters, soft hyphens as hyphens; the block U+FFF0..U+FFFF goes."""
    kept = F.regexp_replace(text, r"[\x{FFF0}-\x{FFFF}]", "")
    return F.translate(kept, "".join(map(chr, SYMBOLS)) + "\u00ad", "".join(map(chr, SYMBOLS.values())) + "-")


def category_counts(text: Column) -> Column:
    """struct<spaces, marks, formats>: white space, nonspacing marks and format characters of a text."""
    return F.struct(
        F.regexp_count(text, F.lit(r"[\p{Z}\t\n\x{0B}\f\r\x{85}]")).alias("spaces"), F.regexp_count(text, F.lit(r"\p{Mn}")).alias("marks"), F.regexp_count(text, F.lit(r"\p{Cf}")).alias("formats")
    )


def first_readable(*layers: Column) -> Column:
    """The first layer that is neither blank nor garbled; else the first that is not blank; else empty text."""
    good = [F.when(~is_garbled(x), x) for x in layers]
    return F.coalesce(*good, *[F.nullif(x, F.lit("")) for x in layers], F.lit(""))


# --- page labels ---

#: Digits of Roman numerals by decimal place.
ROMAN = (
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
)


def roman(n: Column) -> Column:
    """Roman numeral; thousands repeat M without end; below 1 the decimal number."""
    places = [F.element_at(F.array(*map(F.lit, digits)), (F.floor(n / 10**p) % 10 + 1).cast("int")) for p, digits in enumerate(ROMAN)]
    return F.when(n > 0, F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *reversed(places))).otherwise(n.cast("string"))


def alphabetic(n: Column, upper: bool = True) -> Column:
    """A..Z, AA, AB, ...: bijective base 26 of up to seven letters; below 1 the decimal number.

    ``below`` numbers are too short for a letter at place p, which counts 26**p.
    """
    count, letters = n.cast("bigint"), []
    for p in range(7):
        below = sum(26**q for q in range(1, p + 1))
        digit = F.pmod(F.floor((count - 1 - below) / 26**p), F.lit(26)) + (65 if upper else 97)
        letters.append(F.when(count > below, F.char(digit.cast("bigint"))).otherwise(F.lit("")))
    return F.when(n > 0, F.concat(*reversed(letters))).otherwise(n.cast("string"))


def page_label(prefix: Column, style: Column, start: Column, offset: Column) -> Column:
    value = F.greatest(start + offset, F.lit(1))
    capitals = F.when(F.upper(style) == "R", roman(value)).when(F.upper(style) == "A", alphabetic(value)).otherwise(value.cast("string"))
    ordinal = F.when(style.isin("r", "a"), F.lower(capitals)).otherwise(capitals)
    return F.concat(prefix, F.when(F.trim(style) == "", F.lit("")).otherwise(ordinal))
