"""What a query does once, and by how many tasks: work that grew faster than its input, or stayed with one task."""

import pytest
from pyspark.sql import functions as F

from siftlake.functions import filters as B
from siftlake.functions.shape import Shape
from siftlake.operators import chunks as C
from siftlake.operators.items import with_filter
from siftlake.plans import queries as Q
from siftlake.plans.catalog import ChunkIndex, SliceIndex
from siftlake.plans.queries import QUERIES

SHAPE = Shape(128, 4)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def counted(spark):
    """Adds a filter of ``n`` to rows, and counts how often one is made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def of(n):
        made.add(1)
        return bytearray(B.bytes_of_bits([n % 128], SHAPE))

    return lambda n, shift=0: spark.range(n).select((F.col("id") + shift).alias("id"), of.asNondeterministic()("id").alias("filter")), made


@pytest.mark.parametrize("name", ["planner_choice", "search_zero_target_paths"])  # F1, F3
def test_base_is_hashed_before_it_is_searched(spark, sf_dir, name):
    assert "md5(" not in plan(QUERIES[name](spark, sf_dir))


def test_filters_are_made_once_a_row(spark, sf_dir):  # F1, F3
    parts = Q.parts(spark, sf_dir)
    assert plan(parts.where(B.bf_contains_words(F.col("filter"), Q.target("ring", "small")))).count("md5(") <= 2  # once in the filter, once in the rows
    hashed = []

    @F.udf("array<string>")
    def items(n):
        seen.add(1)
        return [str(n)]

    seen = spark.sparkContext.accumulator(0)
    wide = with_filter(spark.range(5).select("id", items.asNondeterministic()("id").alias("i")), F.col("i"), Shape(8192, 4))
    hashed = [bytes(r["filter"]) for r in wide.orderBy("id").collect()]
    assert len(set(hashed)) == 5 and all(len(h) == 1024 for h in hashed)


def test_slice_changes_read_their_rows_once(spark, tmp_path, counted):  # F4
    rows, made = counted
    index = SliceIndex(spark, str(tmp_path / "s"), ["id"], SHAPE).build(spark.range(20).select("id", F.lit(bytearray(B.bytes_of_bits([3], SHAPE))).alias("filter")))
    before = made.value
    index.update(rows(8))
    assert made.value - before == 8
    index.insert(rows(6, 18))
    assert made.value - before == 14
    index.delete(spark.range(2, 4))
    assert sorted(r["id"] for r in index.search(B.bytes_of_bits([5], SHAPE)).collect()) == [5, 23]
    assert sorted(r["id"] for r in index.search(bytes(16)).collect()) == [i for i in range(24) if i not in (2, 3)]
    index.compact()
    assert sorted(r["id"] for r in index.search(bytes(16)).collect()) == [i for i in range(24) if i not in (2, 3)]


def test_a_small_file_is_hashed_by_many_tasks(spark, sf_dir):  # F5, F6
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert Q.stored_parts(spark, sf_dir, "test").select(F.input_file_name()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_gated_search_reads_a_stored_index(spark, sf_dir):  # F6
    found = plan(QUERIES["gated_search"](spark, sf_dir))
    assert "md5(" not in found and "posexplode" not in found.lower()


def test_an_empty_index_is_stored_and_searched(spark, tmp_path):  # F6
    none = C.chunks(spark.createDataFrame([], "id long, filter binary"), ["id"])
    assert C.search_chain(Q.kept_index(none, "none"), ["id"], Q.target("ring")).count() == 0


def test_chunk_changes_read_keys_and_their_rows_once(spark, tmp_path, counted):  # F7
    rows, made = counted
    index = ChunkIndex(spark, str(tmp_path / "c"), ["id"]).build(spark.createDataFrame([(i, bytearray(16) if i == 6 else None if i == 7 else bytearray(B.bytes_of_bits([3, 70], SHAPE))) for i in range(20)], "id long, filter binary"))
    before = made.value
    index.update(rows(8))
    assert made.value - before == 8
    index.delete(spark.range(2, 4))
    held = sorted(r["id"] for r in index.keys().collect())
    assert held == sorted(r["id"] for r in index.table().select("id").distinct().collect()) == [i for i in range(20) if i not in (2, 3, 6, 7)]
    assert not any("/rows/" in f for f in index.keys().inputFiles())
    index.compact()
    assert sorted(r["id"] for r in index.keys().collect()) == held


def test_phrase_index_is_cut_by_size(spark, sf_dir):  # F2
    with_conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in with_conf}
    for k, v in with_conf.items():
        spark.conf.set(k, v)
    try:
        found = QUERIES["phrase_search_stored"](spark, sf_dir)
        assert sum("siftlake-phrases" in f for f in found.inputFiles()) > 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
