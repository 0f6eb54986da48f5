"""Filters, predictors, raster functions and file sources."""

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import codecs, raster
from weft.sources import files


def lzw_encode(data: bytes) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    size, width, bits, count, w = 258, 9, 256, 9, b""
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        bits, count = bits << width | table[w], count + width
        table[w + bytes([c])] = size
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
        w = bytes([c])
    bits, count = bits << width | table[w], count + width
    size += 1
    if size >= 1 << width and width < 12:
        width += 1
    bits, count = bits << width | 257, count + width
    pad = -count % 8
    return (bits << pad).to_bytes((count + pad) // 8, "big")


def test_filters(spark):
    data = bytes(np.random.default_rng(0).integers(0, 6, 900).astype(np.uint8))
    raw = zlib.compress(data)
    rows = [("hex", data.hex().encode() + b">"), ("odd", b"41 4>"), ("85", base64.a85encode(data) + b"~>"), ("z", raw), ("raw", raw[2:-4]), ("bad", b"\1\2\3"), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v binary")
    got = {r["k"]: r for r in df.select("k", codecs.decode(F.col("v"), "ASCIIHexDecode").alias("h"), codecs.decode(F.col("v"), "ASCII85Decode").alias("a"), codecs.decode(F.col("v"), "FlateDecode").alias("z")).collect()}
    assert bytes(got["hex"]["h"]) == data and bytes(got["odd"]["h"]) == b"A@" and bytes(got["85"]["a"]) == data
    assert bytes(got["z"]["z"]) == data and bytes(got["raw"]["z"]) == data
    assert got["bad"]["z"] is None and got["none"]["z"] is None
    assert codecs.lzw(lzw_encode(data)) == data
    assert codecs.run_length(b"\x02abc\xfed\x80zz") == b"abcddd"
    chained = spark.createDataFrame([(raw.hex().encode(),)], "v binary").select(codecs.decode(F.col("v"), "ASCIIHexDecode", "FlateDecode").alias("x"))
    assert bytes(chained.first()["x"]) == data
    with pytest.raises(ValueError):
        codecs.decode(F.col("v"), "DCTDecode")


def test_predictors():
    rows = np.random.default_rng(1).integers(0, 256, (5, 6)).astype(np.uint8)
    out, above = b"", np.zeros(6, int)
    for kind, row in enumerate(rows):
        r = row.astype(int)
        left, corner = np.r_[0, 0, r[:-2]], np.r_[0, 0, above[:-2]]
        if kind == 4:
            p = left + above - corner
            near = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
            guess = np.choose(near.argmin(0), [left, above, corner])
        else:
            guess = [0 * r, left, above, (left + above) // 2][kind]
        out += bytes([kind]) + ((r - guess) % 256).astype(np.uint8).tobytes()
        above = r
    assert codecs.png_unpredict(out, 3, 2) == rows.tobytes()
    assert codecs.tiff_unpredict(bytes([1, 2, 3, 250, 10, 1]), 3, 1) == bytes([1, 3, 6, 250, 4, 5])


def test_longest_prefix(spark):
    decode = codecs.longest_prefix({b"\x00\x41": "A", b"\x41": "one", b"\x00\x41\x42": "long"})
    df = spark.createDataFrame([(b"\x00\x41\x42\x41\x7a\x00\x41",)], "v binary")
    assert df.select(decode("v").alias("x")).first()["x"] == "longonezA"


def test_raster(spark):
    y = raster.sampled_nd([F.lit(0.5), F.lit(0.25)], (2, 3), (0, 1, 2, 3, 4, 5), ((0, 1), (0, 1)))[0]
    assert spark.range(1).select(y.alias("y")).first()["y"] == pytest.approx(1.5)
    points = raster.grid(spark, 4, 2)
    t = [r["t"] for r in points.orderBy("y", "x").select(raster.axial_parameter(F.col("x"), F.col("y"), (0, 0), (2, 0), (False, True)).alias("t")).collect()]
    assert t[:4] == [0.0, 0.5, 1.0, 1.0]
    r = points.where("x = 3 AND y = 0").select(raster.radial_parameter(F.col("x"), F.col("y"), (0, 0, 0), (0, 0, 6)).alias("t")).first()["t"]
    assert r == pytest.approx(0.5)
    small = raster.shrink(points.withColumn("v", F.col("x") * 10), 2, ["v"]).orderBy("x").collect()
    assert [s["v"] for s in small] == [5, 25]
    layers = F.array(F.struct(F.lit(200).alias("v"), F.lit(255).alias("alpha")), F.struct(F.lit(0).alias("v"), F.lit(0).alias("alpha")))
    assert spark.range(1).select(raster.composite_stack(layers, F.lit(9)).alias("x")).first()["x"] == 200
    mask = spark.createDataFrame([(0, 0, 7)], "mx long, my long, alpha int")
    assert [m["alpha"] for m in raster.apply_mask(points, mask, (4, 2), (2, 1)).orderBy("y", "x").collect()][:3] == [7, 7, 255]


def test_files(spark, tmp_path):
    for name in ("a/One.PDF", "a/.hidden/x.pdf", "b two.pdf", "c.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"1 0 obj")
    found = files.scan_documents(spark, str(tmp_path)).orderBy("slug").collect()
    assert len(found) == 2 and [f["length"] for f in found] == [7, 7]
    ok = spark.createDataFrame([([0, 10, 20, 5], 25), ([0, 10, 5, 20], 25), ([1, 2], 3), (None, 5)], "r array<bigint>, n bigint")
    assert [r["x"] for r in ok.select(files.signature_ranges_valid(F.col("r"), F.col("n")).alias("x")).collect()] == [True, False, False, False]
    state = spark.createDataFrame([('{"page_order":[1,0],"fields":{"a":"b"}}',)], "s string").select(files.session_from_json(F.col("s")).alias("s"))
    assert state.first()["s"]["page_order"] == [1, 0] and '"fields":{"a":"b"}' in state.select(files.session_to_json(F.col("s")).alias("j")).first()["j"]
    form = files.xfdf(spark.createDataFrame([(1, "b", "x<y"), (0, "a", "1")], "o int, name string, value string"), "o")
    assert form.first()["xfdf"] == '<xfdf><fields><field name="a"><value>1</value></field><field name="b"><value>x&lt;y</value></field></fields></xfdf>'
