"""Literal expectations of single functions."""

import pytest
from pyspark.sql import functions as F

from weft.functions import color, numeric, postscript
from weft.functions import text as T
from weft.operators import layout, lists, reports, search
from weft.sources import reports as sources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,n", [("", 0), ("  \n\t ", 0), ("hello world", 2), ("hello, world! again.", 3), ("don't stop", 2), ("v2_model done", 2)])
def test_word_count(spark, text, n):
    assert one(spark, T.word_count(F.lit(text))) == n


def spans(spark, text, query, **options):
    pages = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return [(r["start"], r["end"]) for r in search.find_matches(pages, query, **options).orderBy("start").collect()]


def test_search_ignores_case(spark):
    assert spans(spark, "Hello hello HELLO", "hello") == [(0, 5), (6, 11), (12, 17)]


def test_search_whole_word(spark):
    assert spans(spark, "cat catalog scatter cat", "cat", whole_word=True) == [(0, 3), (20, 23)]


def test_search_overlaps_and_start(spark):
    assert spans(spark, "aaaa", "aa") == [(0, 2), (1, 3), (2, 4)]
    assert spans(spark, "ananan", "anan") == [(0, 4), (2, 6)]


def test_search_quotes_and_folding(spark):
    assert spans(spark, "x.*y\\Ez x.*y", ".*") == [(1, 3), (9, 11)]
    assert spans(spark, "İİ ab", "ab") == [(3, 5)]
    with pytest.raises(ValueError):
        search.find_matches(spark.createDataFrame([(0, "a")], "doc_id long, text string"), "  ")


def test_search_limits(spark):
    pages = spark.createDataFrame([(0, "a a a a"), (1, "a a a")], "doc_id long, text string")
    found = search.find_matches(pages, "a", case_sensitive=True, whole_word=True)
    assert [(r["doc_id"], r["start"]) for r in search.limit_matches(found, 2, 3).collect()] == [(0, 0), (0, 2), (1, 0)]


def test_context(spark):
    text = "0123456789 abcde " + "x" * 31
    assert one(spark, T.context(F.lit(text), F.lit(11), F.lit(16), 5)) == "...6789 abcde xxxx..."


def test_range_errors():
    with pytest.raises(ValueError):
        T.text_range(F.lit("x"), 5, 1)


@pytest.mark.parametrize("n,want", [(1, "I"), (4, "IV"), (9, "IX"), (40, "XL"), (1994, "MCMXCIV"), (4000, "MMMM"), (0, "0")])
def test_roman(spark, n, want):
    assert one(spark, T.roman(F.lit(n))) == want


@pytest.mark.parametrize("n,want", [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (0, "0")])
def test_alphabetic(spark, n, want):
    assert one(spark, T.alphabetic(F.lit(n))) == want


def test_garbled(spark):
    assert one(spark, T.is_garbled(F.lit(""))) is True
    assert one(spark, T.is_garbled(F.lit("plain text"))) is False
    assert one(spark, T.is_garbled(F.lit("a��"))) is True


def test_decode(spark):
    assert one(spark, T.decode_text(F.lit(bytearray(b"\xfe\xff\x00A\x00\xe9")))) == "Aé"
    assert one(spark, T.decode_text(F.lit(bytearray("é".encode())))) == "é"
    assert one(spark, T.decode_text(F.lit(bytearray(b"\xe9x")))) == "éx"
    assert bytes(one(spark, T.hex_bytes(F.lit("<414>")))) == b"A@"


def test_page_spec(spark):
    assert one(spark, sources.page_spec(F.lit("1-3, 5,,5"))) == [1, 2, 3, 5, 5]
    for bad in ("5-3", "0", "a"):
        with pytest.raises(Exception, match="invalid page range"):
            one(spark, sources.page_spec(F.lit(bad)))


def test_entities_and_forms(spark):
    assert one(spark, sources.resolve_entities(F.lit("&lt;a&gt; &amp;quot;"))) == '<a> "'
    assert one(spark, sources.resolve_numeric_entities(F.lit("a&#65;&#x1F600;b&#xZZ;"))) == "aA😀b&#xZZ;"
    fields = one(spark, sources.form_fields_xfdf(F.lit('<field name="a"><value>1</value><value>2</value></field><field name="b"></field>')))
    assert [(f["name"], f["values"]) for f in fields] == [("a", ["1", "2"])]
    headers = one(spark, sources.object_headers(F.lit("x 1 0 obj << >> 12 3 obj")))
    assert [(h["num"], h["gen"]) for h in headers] == [(1, 0), (12, 3)]


def test_report_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("pdf,page,exact_percent,similarity_percent,total_pixels,diff_pixels,avg_diff,pass,error\na,1,99.5,,10,0,0.1,True,\na,0,1,1,1,1,1,False,bad\n")
    rows = sources.read_compare_csv(spark, str(tmp_path / "r.csv")).collect()
    assert [(r["page"], r["similarity_percent"], r["pass"], r["error"]) for r in rows] == [(1, 0.0, True, "")]
    (tmp_path / "f.tsv").write_text("# note\na.pdf\t1\t80.0\t0.0\tseed\n")
    assert sources.read_floors(spark, str(tmp_path / "f.tsv")).count() == 1
    (tmp_path / "m.tsv").write_text("# head\n# TODO x\ty\t\t\na\tb\t5\tff\n")
    assert [r["todo"] for r in sources.read_manifest(spark, str(tmp_path / "m.tsv")).collect()] == [True, False]


def test_numbers(spark):
    assert one(spark, numeric.points_to_pixels(F.lit(72.0), 150)) == 150
    assert one(spark, numeric.points_to_pixels(F.lit(0.0), 72)) == 1
    assert [one(spark, numeric.rotation_exact(F.lit(a))) for a in (-90, 45, 450)] == [270, 0, 90]
    assert [one(spark, numeric.rotation_nearest(F.lit(a))) for a in (44, 45, 225, 315)] == [0, 90, 270, 0]
    assert one(spark, numeric.duration_ms(F.lit("2ms"))) == 2.0
    assert one(spark, numeric.duration_ms(F.lit("3s"))) == 3000.0
    assert one(spark, numeric.duration_ms(F.lit("5µs"))) == 0.005
    assert str(one(spark, numeric.pdf_date(F.lit("D:20240102030405+01'30'")))) == "2024-01-02 01:34:05"
    assert str(one(spark, numeric.pdf_date(F.lit("D:2024")))) == "2024-01-01 00:00:00"
    assert one(spark, numeric.pdf_date(F.lit("nope"))) is None


@pytest.mark.parametrize(
    "program,inputs,want",
    [
        ("{ 2 copy add 3 1 roll pop pop }", (1, 2), [3]),
        ("{ dup mul exch }", (2, 3), [9, 2]),
        ("{ 3 1 roll }", (1, 2, 3), [3, 1, 2]),
        ("{ 1 index }", (5, 6), [5, 6, 5]),
        ("{ 0 gt { 1 } { 2 } ifelse }", (-1,), [2]),
        ("{ cvi }", (-1.7,), [-1]),
        ("{ true and not }", (3,), [0]),
        ("{ 7 exch idiv -7 3 mod }", (2,), [3, -1]),
        ("{ 0 div }", (1,), [None]),
        ("{ sqrt }", (-1,), [None]),
        ("{ round }", (-0.5,), [-1]),
    ],
)
def test_postscript(spark, program, inputs, want):
    columns = postscript.compile_program(program, *[F.lit(float(i)) for i in inputs])
    row = spark.range(1).select(*[c.alias(f"y{i}") for i, c in enumerate(columns)]).first()
    assert list(row) == want


def test_postscript_errors():
    for bad in ("{ pop }", "{ 1 { 2 } if }", "{ foo }", "{ { }"):
        with pytest.raises(postscript.ProgramError):
            postscript.compile_program(bad)


def test_color(spark):
    assert [one(spark, v) for v in color.cmyk_to_rgb(*[F.lit(0.0)] * 4)] == [255, 255, 255]
    assert one(spark, color.component_to_byte(F.lit(1.0))) == 255
    assert one(spark, color.color_key_hidden(F.array(F.lit(1), F.lit(2)), (0,), (9,))) is False


@pytest.mark.parametrize("mode", sorted(color.SEPARABLE) + sorted(color.NON_SEPARABLE))
def test_blend_range_and_identities(spark, mode):
    pixels = spark.createDataFrame([(a, b, c) for a in (0, 1, 127, 128, 255) for b in (0, 64, 255) for c in (0, 200, 255)], "a int, b int, c int")
    s, d = [F.col("a"), F.col("b"), F.col("c")], [F.col("c"), F.col("a"), F.col("b")]
    rows = pixels.select("a", "b", "c", *[v.alias(f"o{i}") for i, v in enumerate(color.blend(mode, s, d))]).collect()
    for r in rows:
        assert all(0 <= r[f"o{i}"] <= 255 for i in range(3))
        if mode == "multiply" and r["a"] == 255:
            assert r["o0"] == r["c"]
        if mode == "screen" and r["a"] == 0:
            assert r["o0"] == r["c"]


def test_layout(spark):
    items = spark.createDataFrame([(0, 0, 0, 100, 5, "a"), (0, 1, 10, 101, 5, "b"), (0, 2, 0, 50, 5, "c"), (0, 3, 5, 50, 5, "d")], "page long, seq int, x int, y int, width int, text string")
    assert [(r["text"], r["items"]) for r in layout.text_lines(items).orderBy("line").collect()] == [("a b", 2), ("cd", 2)]


def test_lists(spark):
    pages = F.array(*[F.lit(i) for i in range(4)])
    assert one(spark, lists.move(pages, F.lit(1), F.lit(2))) == [0, 1, 2, 3]
    assert one(spark, lists.move(pages, F.lit(0), F.lit(3))) == [1, 2, 0, 3]
    assert one(spark, lists.move(pages, F.lit(3), F.lit(0))) == [3, 0, 1, 2]
    assert one(spark, lists.insert_at(pages, F.lit(9), F.lit(7))) == [0, 1, 2, 3, 7]
    assert one(spark, lists.remove_at(pages, F.lit(0))) == [1, 2, 3]


def test_spine_without_pages(spark):
    none = spark.createDataFrame([], "pdf string, page long")
    left = spark.createDataFrame([("d", 0)], "pdf string, page long")
    assert [(r["page"], r["status"]) for r in reports.page_spine(left, none, "pdf", "page").collect()] == [(0, "right missing")]


def test_tree_guards_against_cycles(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 5, "x"), (5, 4, "y")], "id int, parent_id int, name string")
    rows = lists.flatten_tree(spark, nodes, F.col("parent_id").isNull() | (F.col("id") == 4)).collect()
    assert sorted((r["id"], r["path"]) for r in rows) == [(1, "a"), (2, "a.b"), (3, "a.b.c"), (4, "x"), (5, "x.y")]


def test_tile_components(spark):
    from weft.operators.pixels import tile_components

    spark.sparkContext.setCheckpointDir("/tmp/weft-test-checkpoints")
    found = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (9, 9)], "tile_x long, tile_y long")
    roots = {(r["tile_x"], r["tile_y"]): (r["root_x"], r["root_y"]) for r in tile_components(found).collect()}
    assert roots == {(0, 0): (0, 0), (1, 1): (0, 0), (2, 1): (0, 0), (9, 9): (9, 9)}


def test_dictionary_of_more_terms_than_a_scan_takes(spark):
    from weft.operators import search

    texts = [(0, "w3 W70 w70"), (1, None), (2, "w99 w0w0"), (3, "none")]
    pages = spark.createDataFrame(texts, "doc_id long, text string")
    terms = spark.createDataFrame([(i, f"w{i}") for i in range(100)], "term_id long, term string")
    want = sorted((k, i, n) for k, t in texts for i in range(100) if (n := (t or "").lower().count(f"w{i}")))
    assert sorted(tuple(r) for r in search.dictionary_search(pages, terms).collect()) == want
