"""Indexes, maintenance and slots."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.functions import filters as B
from siftlake.functions import hashing as H
from siftlake.functions.shape import Shape
from siftlake.operators import chunks as C
from siftlake.operators import flow, maintain, slots
from siftlake.operators import slices as S
from siftlake.operators.items import chunks_of_items, merged, with_filter, words

SHAPE = Shape(128, 4)


def table(spark, rows, shape=SHAPE):
    return spark.createDataFrame([(i, bytearray(B.bytes_of_bits(r, shape)) if r is not None else None) for i, r in enumerate(rows)], "k long, filter binary")


def found(df, column="k"):
    return sorted(r[column] for r in df.collect())


def test_key_order():
    """Selectivity first, then position."""
    bits = [8 + b for b in range(8)] + [16 + b for b in range(8)] + [24, 26]
    assert C.target_chunks(B.bytes_of_bits(bits, SHAPE)) == [(1, 255), (2, 255), (3, 5)]
    assert [C.selectivity_of(c) for c in (0xFF, 0xFE, 5, 0x80, 1)] == [255, 127, 3, 1, 1]
    assert [len(C.superset_codes(c)) for c in (0xFF, 0xFE, 5, 0x80, 1, 0)] == [1, 2, 64, 128, 128, 0] and len(C.superset_codes(0, True)) == 256


def test_golden_chunks(spark):
    data = bytes.fromhex("80002020000A000000800020000A0000008000200008020080802000080002000000200008000200")
    want = {2: 10, 4: 32, 5: 32, 7: 128, 10: 10, 12: 32, 14: 128, 17: 2, 18: 8, 20: 32, 22: 128, 25: 2, 27: 8, 29: 32, 30: 128, 31: 128, 33: 2, 35: 8, 37: 32}
    got = C.chunks(spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"\1\2\3"))], "k long, filter binary"), ["k"]).collect()
    assert {r["position"]: r["code"] for r in got} == want and {r["k"] for r in got} == {1}
    assert [p for p, _ in C.target_chunks(data)][:3] == [2, 10, 4]


def test_entries(spark):
    index = C.chunks(table(spark, [{1}, {1, 9}, {9}]), ["k"])
    assert found(C.entries(index, 0)) == [0, 1] and found(C.entries(index, 1, 2)) == [1, 2] and found(C.entries(index, 1, 3)) == []
    r = C.entries(index, 1, 2).where("k = 2").select(C.index_value(["k"]).alias("v"), C.key_bytes(F.col("position"), F.col("code")).alias("b")).first()
    assert tuple(r["v"]) == (1, 2, 2) and bytes(r["b"]) == bytes([0, 0, 0, 1, 0, 0, 0, 2])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sets(st.integers(0, 127), max_size=24), min_size=1, max_size=10), st.sets(st.integers(0, 127), min_size=1, max_size=4))
def test_all_paths_agree(spark, rows, wanted):
    df, t = table(spark, rows), B.bytes_of_bits(wanted, SHAPE)
    want = [i for i, r in enumerate(rows) if wanted <= r]
    index = C.chunks(df, ["k"])
    numbered = df.withColumn("idx", F.col("k"))
    assert found(C.search(index, ["k"], t)) == want
    assert found(C.search_chain(index, ["k"], t)) == want
    many = spark.createDataFrame([("q", bytearray(t))], "query_id string, target binary")
    assert found(C.search_many(index, ["k"], many)) == want
    assert found(S.search(S.slices(numbered), S.busy(numbered), t, SHAPE), "idx") == want


def test_zero_targets(spark):
    df = table(spark, [{1}, {2}, set()])
    index, rows = C.chunks(df, ["k"]), df.withColumn("idx", F.col("k"))
    assert found(C.search(index, ["k"], b"")) == [] and found(C.search(index, ["k"], bytes(16), "all", df)) == [0, 1, 2] and found(C.search_chain(index, ["k"], b"")) == []
    assert found(S.search(S.slices(rows), S.busy(rows), b"", SHAPE), "idx") == [0, 1, 2]
    assert found(S.search(S.slices(rows), S.busy(rows), b"", SHAPE, "none"), "idx") == []
    with pytest.raises(ValueError):
        S.search(S.slices(rows), S.busy(rows), bytes(17), SHAPE)
    # beyond the shape's bits: chunks find nothing, slices ignore them
    small = Shape(100, 2)
    assert found(S.search(S.slices(rows), S.busy(rows), B.bytes_of_bits([1, 120], SHAPE), small), "idx") == [0]
    assert found(C.search(index, ["k"], B.bytes_of_bits([1, 120], SHAPE))) == []


def test_repeated_keys_are_never_missed(spark):
    """Several index rows of a key at a position, of one filter or of two, and keys that are part of the index's."""
    rows = spark.createDataFrame([(1, "a", bytearray(B.bytes_of_bits(b, SHAPE))) for b in ({1, 9}, {1, 9}, {1})] + [(2, "a", bytearray(B.bytes_of_bits({1, 9, 20}, SHAPE))), (3, "b", bytearray(B.bytes_of_bits({9}, SHAPE))), (4, "b", bytearray(B.bytes_of_bits({1}, SHAPE)))], "k long, p string, filter binary")
    index, t = C.chunks(rows, ["k", "p"]), B.bytes_of_bits([1, 9], SHAPE)
    many = spark.createDataFrame([("q", bytearray(t))], "query_id string, target binary")
    for got in (C.search(index, ["k"], t), C.search_chain(index, ["k"], t), C.search_many(index, ["k"], many)):
        assert found(got) == [1, 2]
    assert found(C.search(index, ["p"], t), "p") == found(C.search_chain(index, ["p"], t), "p") == ["a", "b"]
    wide = Shape(4096, 2)
    every = spark.createDataFrame([(i, bytearray(B.bytes_of_bits(range(0, 4096, 8), wide))) for i in (1, 1, 2)], "k long, filter binary")
    assert found(C.search(C.chunks(every, ["k"]), ["k"], B.bytes_of_bits(range(0, 4096, 8), wide))) == [1, 2]
    twice = maintain.upsert(index.select("k", "position", "code"), rows.where("k = 1").select("k", "filter"), ["k"])
    assert twice.where("k = 1").count() == 2


def test_three_phrases(spark):
    shape = Shape.from_np(10, 1 / 10)
    bits = lambda text: sorted({b for r in H.item_bits(text.split(" "), shape) for b in r})
    t = S.SlicedTable(spark, shape)
    t, ids = t.add(bits("Hello World"), bits("Good bye cruel World"), bits("Now is the time"))
    assert ids == [0, 1, 2] and t.count() == 3 and t.max_index() == 64
    assert t.search(bits("Hello")) == [0] and t.search(bits("World")) == [0, 1]
    gone = t.delete(1)
    assert gone.search(bits("World")) == [0] and gone.count() == 2 and [r["deleted"] for r in gone.entries().orderBy("idx").collect()] == [False, True, False]
    again, ids = gone.add(bits("Callay"))
    assert ids == [1] and again.search(bits("Callay")) == [1] and again.search(bits("World")) == [0]
    moved = t.update(1, bits("Hello Mr. Chips"))
    assert moved.search(bits("World")) == [0] and moved.search(bits("Hello")) == [0, 1]
    assert t.drop().count() == 0


def test_all_ones(spark):
    ones, low = set(range(128)), {w * 64 + b for w in range(2) for b in range(8)}
    rows = table(spark, [ones, low, ones]).withColumn("idx", F.col("k"))
    m, live = S.slices(rows), S.busy(rows)
    look = lambda bits, busy=live: found(S.search(m, busy, B.bytes_of_bits(bits, SHAPE), SHAPE), "idx")
    assert look(low) == [0, 1, 2] and look(ones) == [0, 2]
    assert look(ones, maintain.release(live, spark.createDataFrame([(0,)], "idx long"))) == [2]
    assert sorted((r["idx"], r["bit"]) for r in S.filters_back(m).where("idx = 1").collect()) == [(1, b) for b in sorted(low)]


def test_allocation(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "idx long")
    new = lambda xs: spark.createDataFrame([(x,) for x in xs], "n long")
    ten = ids(range(10))
    assert S.busy(ten).first()["word"] == 0x3FF
    less = maintain.release(S.busy(ten), ids([5]))
    assert less.first()["word"] == 0x3DF and tuple(S.cardinality(less).first()) == (9, 64)
    given_ = S.allocate(ids([i for i in range(64) if i != 5]), new([1, 2, 3]), "n")
    assert [r["idx"] for r in given_.orderBy("n").collect()] == [5, 64, 65]
    assert [r["idx"] for r in S.allocate(ids([]), new([7, 9]), "n").orderBy("n").collect()] == [0, 1]


def test_ranked(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 10_007).alias("x"))
    got = {r["x"]: r["idx"] for r in S.ranked(rows, "x", 16).collect()}
    assert got == {x: i for i, x in enumerate(sorted(got))}
    named = S.ranked(rows.select(F.col("x").cast("string").alias("x")), "x")
    assert found(named, "idx") == list(range(5000))


def test_maintenance(spark):
    old = table(spark, [{1, 9}, {2, 20}, None, {3}])
    new = table(spark, [{1, 10}, {2, 20}, {4}, None])
    changes = maintain.diff(old, new, ["k"])
    assert {(r["k"], r["position"], r["code"], r["op"]) for r in changes.collect()} == {(0, 1, 2, "delete"), (0, 1, 4, "insert"), (2, 0, 16, "insert"), (3, 0, 8, "delete")}
    rows = lambda df: sorted(map(tuple, df.select("k", "position", "code").collect()))
    assert rows(maintain.apply_diff(C.chunks(old, ["k"]), changes, ["k"])) == rows(C.chunks(new, ["k"]))
    assert rows(maintain.upsert(C.chunks(old, ["k"]), new.where("k < 2"), ["k"])) == rows(C.chunks(new.where("k < 2").union(old.where("k >= 2")), ["k"]))
    assert rows(maintain.delete(C.chunks(old, ["k"]), old.where("k = 0"), ["k"])) == rows(C.chunks(old.where("k <> 0"), ["k"]))
    assert rows(maintain.delete_range(C.chunks(old, ["k"]), F.col("k") < 3)) == rows(C.chunks(old.where("k = 3"), ["k"]))
    again = maintain.upsert(maintain.delete(C.chunks(old, ["k"]), old.where("k = 0"), ["k"]), new.where("k = 0"), ["k"])
    assert found(C.search(again, ["k"], B.bytes_of_bits([9], SHAPE))) == []  # no stale bit comes back


def test_latest_and_live(spark):
    m = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 5, None)], "k long, at long, v string")
    assert sorted(map(tuple, maintain.latest(m, ["k"], ["at"]).collect())) == [(1, 3, "b"), (2, 5, None)]
    e = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2020-01-01 00:00:00', 10), (2, TIMESTAMP'2020-01-01 00:00:00', 100), (3, TIMESTAMP'2019-01-01 00:00:00', NULL) t(k, ts, ttl)")
    assert found(maintain.live(e, F.lit("2020-01-01 00:00:10").cast("timestamp"))) == [2, 3]
    assert maintain.unique_rows(m, ["k"]).count() == 2
    v = m.withColumn("filter", F.col("v"))
    assert [r["before"] for r in maintain.versions(v, ["k"], ["at"]).where("k = 1").orderBy("at").collect()] == [None, "a", "c"]


def test_slots(spark):
    s = spark.createDataFrame([(0, 1, 0, 400, 400), (1, 1, 400, 700, 700), (2, 0, 1100, 600, 600), (3, 3, 1700, 550, 550), (4, 1, 2250, 600, 520)], "block long, flags int, offset long, len long, alloc long")
    assert slots.best_fit(s, 500).first()["block"] == 1 and slots.best_fit(s, 100).first()["block"] == 0 and slots.best_fit(s, 900).count() == 0
    keys = spark.createDataFrame([(2, bytearray(b"key"))], "block long, key binary")
    ids = spark.createDataFrame([(0, True, 2), (1, True, 0), (2, False, None)], "idx long, initialised boolean, reference long")
    assert [(r["idx"], bytes(r["key"])) for r in slots.get(ids, s, keys).collect()] == [(0, b"key")]
    assert found(slots.matching(ids, 0, 0), "idx") == [0, 1] and found(slots.matching(ids, 9, None), "idx") == [2]
    s2, k2, at = slots.place(s, keys, 2, b"x" * 650)
    state = {r["block"]: (r["flags"], r["len"], r["alloc"]) for r in s2.collect()}
    assert at == 1 and state[1] == (0, 650, 700) and state[2][0] == 1
    s3, _, at = slots.place(s2, k2, None, b"y" * 800)
    assert at == 5 and {r["block"]: r["offset"] for r in s3.collect()}[5] == 2770
    _, _, at = slots.place(s, keys, 2, b"z" * 20)
    assert at == 2


def test_items(spark):
    df = spark.createDataFrame([(1, "the  quick the "), (2, ""), (3, None)], "k long, text string")
    direct = chunks_of_items(df, ["k"], words(F.col("text")), SHAPE)
    through = C.chunks(with_filter(df, words(F.col("text")), SHAPE), ["k"])
    assert sorted(map(tuple, direct.select("k", "position", "code").collect())) == sorted(map(tuple, through.collect()))
    two = table(spark, [{1}, {70, 3}]).withColumn("g", F.lit("x"))
    assert B.bits_of_bytes(bytes(merged(two, ["g"]).first()["filter"])) == [1, 3, 70]


def test_flow(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x long")
    x = F.col("x")
    assert found(flow.map_with(df.where("x > 0"), k=x * 2)) == [2, 4, 4]
    assert flow.filter_keep(df, x > 1).count() == 2 and flow.filter_drop(df, x > 1).count() == 2
    assert flow.and_then(df, df, df).count() == 12 and flow.unique(df).count() == 3
    assert found(flow.map_filter(df, "k", F.when(x == 2, x))) == [2, 2]
    assert found(flow.flatten(spark.createDataFrame([([1, 2],)], "k array<long>"), "k")) == [1, 2]
    assert flow.empty(spark, "x long").count() == 0 and flow.next_row(flow.empty(spark, "x long")) is None and flow.next_row(flow.singleton(spark, (4,), "x long"))["x"] == 4
    rows, seen = flow.counted(df)
    assert len(rows.collect()) == 4 and seen.get["count"] == 4
    assert sorted(map(str, flow.random_order(df, 3).collect())) == sorted(map(str, df.collect()))
