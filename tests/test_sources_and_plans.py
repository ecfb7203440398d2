"""Sources, stored indexes, the stream, the command line, and every registered query against its SQL."""

import importlib.util
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from siftlake.functions import filters as B
from siftlake.functions.hashing import item_bits, md5_item_bits
from siftlake.functions.options import ChunkOptions
from siftlake.functions.shape import Shape
from siftlake.operators import chunks as C
from siftlake.operators.items import with_filter
from siftlake.plans import catalog, console
from siftlake.plans.queries import QUERIES, SQL
from siftlake.sources import dumps, filter_source
from siftlake.sources import geonames as G
from siftlake.streaming.maintain import StreamedIndex

SHAPE = Shape(128, 4)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def line(i, name, country="", code="", alternates=""):
    return "\t".join([i, name, name, alternates, *[""] * 3, code, country, *[""] * 10])


@pytest.fixture()
def tsv(tmp_path):
    p = tmp_path / "in.tsv"
    p.write_text("\n".join([line("1", "Xixerella", "AD", "PPL", "a,b"), line("2", "Las Vegas", "US", "PPL"), line("3", "El \"Tarter", "AD", "PPL", ",".join(f"n{i}" for i in range(14)))]) + "\n")
    return str(p)


def test_records(spark, tsv, tmp_path):
    rows = G.read_tsv(spark, tsv)
    assert rows.columns == list(G.FIELDS) and rows.count() == 3 and G.read_tsv(spark, tsv, 2).count() == 2
    G.write_tsv(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, G.read_tsv(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, rows.collect()))
    made = {r["geonameid"]: set(B.bits_of_bytes(bytes(r["filter"]))) for r in G.with_filters(rows).collect()}
    bits = lambda *xs: {b for r in item_bits(xs, G.SHAPE) for b in r}
    assert made["1"] == bits("Xixerella", "AD", "PPL", "a", "b") and made["3"] == bits('El "Tarter', "AD", "PPL", *[f"n{i}" for i in range(10)])
    assert G.by_id(rows, "2").first()["name"] == "Las Vegas"
    (tmp_path / "short.tsv").write_text("1\tx\n" + line("2", "y") + "\n")
    assert G.read_tsv(spark, str(tmp_path / "short.tsv"), strict=False).count() == 1
    with pytest.raises(Exception, match="too short"):
        G.read_tsv(spark, str(tmp_path / "short.tsv")).collect()


def test_console(spark, tsv, tmp_path, capsys):
    found = console.main([str(tmp_path), "--load", tsv, "--find", "AD", "PPL"], spark)
    assert {r["geonameid"] for r in found.collect()} == {"1", "3"} and "Xixerella" in capsys.readouterr().out
    assert console.main([str(tmp_path)], spark).count() == 3


def test_filter_source(spark, tmp_path):
    rows = [(i, i % 3, bytearray(B.bytes_of_bits({i, i + 1, 100}, SHAPE)) if i % 7 else None) for i in range(50)]
    spark.createDataFrame(rows, "k long, g long, filter binary").write.parquet(str(tmp_path / "t"))
    filter_source.register(spark)
    load = lambda: spark.read.format("bloom").option("path", str(tmp_path / "t")).load()
    df = load()
    t = bytearray(B.bytes_of_bits({11, 100}, SHAPE))
    assert sorted(r["k"] for r in df.where(F.col("filter") == F.lit(t)).collect()) == [10, 11]
    assert [r["k"] for r in load().where((F.col("filter") == F.lit(t)) & (F.col("g") == 2)).collect()] == [11]
    assert load().count() == 50 and load().where("g = 1").count() == 17


def test_filter_source_reads_by_slices(spark, tmp_path, monkeypatch):
    """Only row groups that hold the target are read, and the filters themselves not at all; odd filters are tested one by one."""
    import pyarrow.parquet as pq

    rows = [(i, bytearray(B.bytes_of_bits({i % 64, 100}, SHAPE))) for i in range(640)]
    table = spark.createDataFrame(rows, "k long, filter binary").toArrow().sort_by("filter")
    (tmp_path / "t").mkdir()
    pq.write_table(table, tmp_path / "t" / "a.parquet", row_group_size=64)
    assert filter_source.index(spark, str(tmp_path / "t")) > 0
    reader = filter_source.FilterReader(str(tmp_path / "t"), "filter", ["k"], 1 << 20)
    read, plain = [], pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, g, columns=None, **k: read.append((g, columns)) or plain(self, g, columns=columns, **k))
    for target, want in ((B.bytes_of_bits({7, 100}, SHAPE), [i for i in range(640) if i % 64 == 7]), (B.bytes_of_bits({7, 101}, SHAPE), []), (bytes(16), list(range(640)))):
        reader.target = target
        read.clear()
        got = sorted(k for p in reader.partitions() for b in reader.read(p) for k in b.column("k").to_pylist())
        assert got == want
        assert len(read) <= 2 and all(c == ["k"] for _, c in read) if any(target) else len(read) == 10
    spark.createDataFrame([(1, bytearray(b"\1" * 8)), (2, bytearray(b"\1" * 16)), (3, None)], "k long, filter binary").coalesce(1).write.parquet(str(tmp_path / "odd"))
    filter_source.index(spark, str(tmp_path / "odd"))
    load = lambda: spark.read.format("bloom").option("path", str(tmp_path / "odd")).option("split", 1000).load()
    filter_source.register(spark)
    find = lambda t: sorted(r["k"] for r in load().where(F.col("filter") == F.lit(bytearray(t))).collect())
    assert find(b"\1" * 8) == [1, 2] and find(b"\1" * 8 + bytes(8)) == [2] and find(b"\1" * 3) == [1, 2] and load().count() == 3


def test_stored_indexes(spark, tmp_path):
    base = with_filter(spark.createDataFrame([(i, f"w{i % 5}", f"v{i % 3}") for i in range(90)], "k long, a string, b string"), F.array("a", "b"), SHAPE)
    t = B.bytes_of_bits(md5_item_bits(["w1", "v2"], SHAPE), SHAPE)
    want = sorted(r["k"] for r in base.where(B.bf_contains_words(F.col("filter"), t)).collect())
    index = catalog.ChunkIndex(spark, str(tmp_path / "c"), ["k"], ChunkOptions.parse({"numberOfBits": "128", "numberOfItems": "2", "numberOfFunctions": "4"})).build(base)
    cut = catalog.SliceIndex(spark, str(tmp_path / "s"), ["k"], SHAPE).build(base)
    gated = catalog.ChunkIndex(spark, str(tmp_path / "c"), ["k"], ChunkOptions(gated=True))
    keys = lambda df: sorted(r["k"] for r in df.collect())
    assert want and keys(index.search(t)) == keys(cut.search(t)) == keys(gated.search(t)) == want
    assert keys(catalog.search(base, t, ["k"], index)) == keys(catalog.search(base, t, ["k"], index, rows=90)) == keys(catalog.search(base, t, ["k"], cut)) == want
    assert keys(catalog.search(base, t, ["k"], index, residual=F.col("k") > 30)) == [k for k in want if k > 30]
    assert 60 <= index.estimated_rows() <= 100 and cut.estimated_rows() == 90
    assert index.build(base.limit(0)).table().count() > 0
    for stored in (index, cut):
        stored.insert(base.where("k < 3").select((F.col("k") + 500).alias("k"), "filter"))
        stored.update(base.where("k = 7 or k = 8").select(F.when(F.col("k") == 7, 8).otherwise(7).alias("k"), "filter").union(base.limit(1).select((F.col("k") - 99).alias("k"), "filter")))
        stored.delete(base.where("k >= 80"))
        model = {r["k"]: bytes(r["filter"]) for r in base.collect()}
        model |= {500 + k: model[k] for k in range(3)}
        model[7], model[8] = model[8], model[7]
        model = {k: f for k, f in model.items() if not 80 <= k < 90}
        now = sorted(k for k, f in model.items() if all(a & b == b for a, b in zip(f, t, strict=True)))
        assert keys(stored.search(t)) == now
        stored.compact()
        assert keys(stored.search(t)) == now and keys(stored.search(B.bytes_of_bits([3], SHAPE))) == sorted(k for k, f in model.items() if 3 in B.bits_of_bytes(f))
    assert max(r["idx"] for r in cut.table("ids").collect()) < 93  # ids of rows that went are used again by later ones
    cut.insert(base.where("k = 85"))
    assert min(r["idx"] for r in cut.table("ids").where("k = 85").collect()) < 93
    for few in (1, 10**6):
        for zero in ("none", "all"):
            ruled = catalog.ChunkIndex(spark, index.path, ["k"], ChunkOptions(zero_target=zero))
            assert catalog.search(base.where("k < 80"), bytes(16), ["k"], ruled, few).count() == (80 if zero == "all" else 0)
        assert keys(catalog.search(base, t + bytes(8), ["k"], index, few)) == [k for k in keys(catalog.search(base, t, ["k"], index, few))]
    index.truncate()
    assert index.table().count() == 0 and index.estimated_rows() == 0
    index.drop()
    cut.drop()
    assert not os.path.exists(index.path) and not os.path.exists(cut.path)
    with pytest.raises(ValueError):
        catalog.check_target(bytes(65_536))
    with pytest.raises(ValueError):
        catalog.check_target(None)


def test_pushdown_reaches_the_scan(spark, tmp_path):
    base = with_filter(spark.createDataFrame([(i, f"w{i % 5}") for i in range(20)], "k long, a string"), F.array("a"), SHAPE)
    index = catalog.ChunkIndex(spark, str(tmp_path / "c"), ["k"]).build(base)
    plan = index.search(B.bytes_of_bits(md5_item_bits(["w1"], SHAPE), SHAPE))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [position" in plan.replace("PartitionFilters: [(", "PartitionFilters: [") and "Python" not in plan


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    typed = lambda df: with_filter(df, F.array("v"), SHAPE)
    target = lambda v: B.bytes_of_bits(md5_item_bits([v], SHAPE), SHAPE)
    kept = StreamedIndex(spark, str(tmp_path / "t"), ["k"], ["at"], typed, F.col("v").isNull())
    for rows in ([(1, 1, "a"), (2, 1, "a"), (1, 2, "b")], [(1, 1, "late"), (2, 3, None), (3, 1, "a")]):
        spark.createDataFrame(rows, "k long, at long, v string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k long, at long, v string").parquet(str(source))
        kept.run(stream, str(tmp_path / "ckpt")).awaitTermination()
    found = lambda v: sorted(r["k"] for r in C.search(kept.index(), ["k"], target(v)).collect())
    assert found("a") == [3] and found("b") == [1] and found("late") == []
    assert kept.rows().count() == 3
    again = StreamedIndex(spark, str(tmp_path / "t"), ["k"], ["at"], typed, F.col("v").isNull())  # after a restart, without new data
    assert again.rows().count() == 3 and again.index().count() == kept.index().count()
    touched = [p for p in (tmp_path / "t" / "data").iterdir() if p.name == "v1"][0]
    assert len(list((touched / "rows").glob("bucket=*"))) <= 3
    with pytest.raises(ValueError):
        StreamedIndex(spark, str(tmp_path / "none"), ["k"], ["at"], typed).rows()


def test_dump(spark, tmp_path):
    rows = dumps.filter_rows(spark.createDataFrame([(0, False, bytearray(b"\x01\xff")), (1, True, None)], "idx long, deleted boolean, filter binary"))
    assert sorted(map(tuple, rows.collect())) == [(0, "false", "0x01FF"), (1, "true", None)]
    dumps.write_csv(rows, str(tmp_path / "d"))
    assert spark.read.option("header", True).csv(str(tmp_path / "d")).columns == ["index", "deleted", "filter"]


def _plain(v):
    return round(v, 6) if isinstance(v, float) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


def compare(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = run(spark, sf_dir), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    ours = sorted((tuple(_plain(r[c]) for c in order) for r in got.collect()), key=repr)
    theirs = sorted((tuple(_plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], SQL[name])


def test_entry(spark, sf_dir):
    at = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry", at)
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert entry.entry(spark).columns == ["p_partkey", "p_name", "p_brand"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert QUERIES["shuffle_sample"](spark, sf_dir).count() == 100
