"""Shapes, options, hashes and filter functions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.functions import filters as B
from siftlake.functions import hashing as H
from siftlake.functions.options import ChunkOptions, SliceOptions, check_column, parse_bool, parse_int
from siftlake.functions.shape import Shape

GOLDEN = Shape(302, 21)
FILTERS = {
    ("Xixerella",): "80002020000A000000800020000A0000008000200008020080802000080002000000200008000200",
    ("AD",): "00410000041000000000410000041000104000010000041000104000010400000000104000010400",
    ("US",): "00000000000000000000000000000000000000015554000000000000000000000000000000000000",
    ("Las Vegas", "US"): "00004010100000044000001004000100100004055555004004040100000040400000004040100000",
}


@pytest.mark.parametrize("n,p,m,k", [(10, 1 / 2_000_000, 302, 21), (12, 1 / 1000, 173, 10), (10, 1 / 10, 48, 3), (1, 0.3934, 2, 1)])
def test_shapes(n, p, m, k):
    assert Shape.from_np(n, p) == Shape(m, k)


def test_estimates():
    assert round(GOLDEN.expected_bits(10), 2) == 151.51 and round(GOLDEN.entries_per_row(10), 2) == 37.75
    assert math.isclose(GOLDEN.fpp(10), 5.1e-7, rel_tol=0.05) and math.isclose(GOLDEN.fpp(14), 4.8e-5, rel_tol=0.05)
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            Shape(*bad)


def test_options():
    assert parse_int({}, "a") == 0 and parse_int({"a": "1"}, "a") == 1
    with pytest.raises(ValueError):
        parse_int({"a": "2.3"}, "a")
    assert all(parse_bool(x) for x in ("Y", "t", "1", "ON", "yes", "True")) and not any(parse_bool(x, True) for x in ("n", "F", "0", "off", "NO", "false"))
    assert parse_bool("maybe", True) and not parse_bool(None)
    assert ChunkOptions.parse({}).ratio == 0 and ChunkOptions.parse({"numberOfBits": "302", "numberOfItems": "10"}).ratio == 0
    assert round(ChunkOptions.parse({"numberOfBits": "302", "numberOfItems": "10", "numberOfFunctions": "21", "usePrimaryFilter": "y"}).ratio, 2) == 37.75
    assert SliceOptions.parse({"numberOfBits": "302"}).bits == 302
    with pytest.raises(ValueError):
        SliceOptions.parse({})
    check_column("regular")
    with pytest.raises(ValueError):
        check_column("static")


@pytest.mark.parametrize("items", FILTERS)
def test_murmur_golden(items):
    bits = {b for row in H.item_bits(items, GOLDEN) for b in row}
    assert B.bytes_of_bits(bits, GOLDEN).hex().upper() == FILTERS[items]
    assert B.bits_of_bytes(bytes.fromhex(FILTERS[items])) == sorted(bits)


def test_small_shape_and_empty_items():
    shape = Shape(48, 3)
    join = lambda *xs: B.bytes_of_bits({b for r in H.item_bits(xs, shape) for b in r}, shape).hex().upper()
    assert (join("Hello", "World"), join("Hello"), join("World")) == ("00000005800A0002", "0000000500000002", "00000000800A0000")
    assert H.item_bits(["", " \t", None], shape) == [[], [], []] and H.item_bits([" Hello "], shape) == H.item_bits(["Hello"], shape)


def test_murmur_of_many_lengths():
    """Each value hashed with others equals the value hashed alone."""
    values = [bytes(range(n % 256)) * (1 + n // 256) for n in range(70)]
    both = H.murmur128(values)
    for i, v in enumerate(values):
        one = H.murmur128([v])
        assert (both[0][i], both[1][i]) == (one[0][0], one[1][0])


def test_contains_table(spark):
    cases = [(None, None, True), (None, "01", False), ("01", None, True), ("03", "01", True), ("01", "03", False), ("01", "0100", False), ("01FF", "01", True), ("01", "", True), ("", "00", False), ("FF00", "0000", True)]
    df = spark.createDataFrame(cases, "c string, t string, want boolean").select(F.unhex("c").alias("c"), F.unhex("t").alias("t"), "want")
    B.register(spark)
    df.createOrReplaceTempView("cases")
    for r in df.select("want", B.bf_contains(F.col("c"), F.col("t")).alias("got")).collect():
        assert r["want"] == r["got"]
    assert spark.sql("SELECT count(*) FROM cases WHERE bf_contains(c, t) <> want").first()[0] == 0


def test_words_hex_and_cardinality(spark):
    words = [0x2600201000084008, 0x9008804002010200, 0x4220030080048000, 0x000C00881008204020 & (2**64 - 1), 0x0000006208010800]
    data = b"".join(w.to_bytes(8, "big") for w in words)
    df = spark.createDataFrame([(bytearray(data),)], "f binary")
    r = df.select(B.decode_words(F.col("f")).alias("w"), B.bits_of(F.col("f")).alias("b"), B.hex_string(F.col("f")).alias("h"), B.cardinality(F.col("f")).alias("n"), B.encode_words(B.decode_words(F.col("f"))).alias("e"), B.from_hex(B.hex_string(F.col("f"))).alias("x")).first()
    assert [w % 2**64 for w in r["w"]] == words and r["b"] == B.bits_of_bytes(data) and r["n"] == sum(w.bit_count() for w in words)
    assert r["h"] == "0x" + data.hex().upper() and bytes(r["e"]) == data and bytes(r["x"]) == data


def test_adjust_and_checks(spark):
    shape = Shape(100, 3)
    assert B.adjust(b"\x01", shape) == b"\x01" + bytes(15) and B.adjust(bytes(16), shape) == bytes(16)
    with pytest.raises(ValueError):
        B.adjust(bytes(17), shape)
    df = spark.createDataFrame([(bytearray(16),), (bytearray(15),)], "f binary")
    assert df.limit(1).select(B.checked(F.col("f"), shape)).count() == 1
    with pytest.raises(Exception, match="words"):
        df.select(B.checked(F.col("f"), shape)).collect()
    with pytest.raises(Exception, match="64K"):
        spark.createDataFrame([(bytearray(65_535),)], "f binary").select(B.checked(F.col("f"))).collect()


def test_bitmaps(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [5, 4, 3, 2, 1])], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    r = df.select(B.word_or(a, b).alias("o"), B.word_and(a, b).alias("n"), B.word_xor(a, b).alias("x"), B.set_bits(a).alias("s"), B.set_bits(a, 256).alias("l"), B.is_set(a, F.lit(65)).alias("t"), B.is_set(a, F.lit(9999)).alias("f"), B.with_bit(a, F.lit(400)).alias("g"), B.with_bit(a, F.lit(0), False).alias("c")).first()
    assert r["o"] == [5, 6, 3, 6, 5] and r["n"] == [1, 0, 3, 0, 1] and r["x"] == [4, 6, 0, 6, 4]
    assert r["s"] == [0, 65, 128, 129, 194, 256, 258] and r["l"] == [0, 65, 128, 129, 194]
    assert r["t"] and not r["f"] and r["g"] == [1, 2, 3, 4, 5, 0, 1 << 16] and r["c"] == [0, 2, 3, 4, 5]
    for bad in (B.is_set(a, F.lit(-1)), B.word_or(a, F.slice(b, 1, 2)), B.with_bit(a, F.lit(-1))):
        with pytest.raises(Exception, match="negative|differ"):
            df.select(bad).collect()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sets(st.integers(0, 127), max_size=20), min_size=1, max_size=8), st.sets(st.integers(0, 127), max_size=4))
def test_contains_is_superset(spark, rows, wanted):
    shape = Shape(128, 4)
    df = spark.createDataFrame([(i, bytearray(B.bytes_of_bits(r, shape))) for i, r in enumerate(rows)], "i long, f binary")
    t = B.bytes_of_bits(wanted, shape)
    got = df.select("i", B.bf_contains(F.col("f"), F.lit(bytearray(t))).alias("a"), B.bf_contains_words(F.col("f"), t).alias("b")).collect()
    for r in got:
        assert r["a"] == r["b"] == (wanted <= rows[r["i"]])


def test_md5_bits_on_both_sides(spark):
    shape = Shape(302, 21)
    got = spark.createDataFrame([(["a", "", "é", None],)], "x array<string>").select(H.md5_bits(F.col("x"), shape).alias("b")).first()["b"]
    assert got == H.md5_item_bits(["a", "é"], shape)
    assert np.all(np.array(got) < 302)
