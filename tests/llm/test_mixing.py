"""Mixing against its SQL, and what holds of any mix."""

import re

import pytest
from pyspark.sql import functions as F

from siftlake.llm.mixing import OP7_SQL, in_order, mix, op7_mixing
from tests.test_sources_and_plans import compare


def targets_by_hand(sizes, weights=(3, 1, 2)):
    """Share, stop at the cap, share the excess again, until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [n for n in sizes if n is None]
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    due, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = due / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * level >= 2 * sizes[n]}
        for n in full or open_:
            out[n] = 2.0 * sizes[n] if full else weight[n] * level
            due -= out[n]
        open_ -= full or open_
    return out


def test_query(spark, sf_dir):
    compare(spark, sf_dir, op7_mixing, OP7_SQL)
    plan = op7_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_mix(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 5}") for i in range(1500)] + [(5000 + i, "hot word here", "hot") for i in range(1500)]
    rows += [(None, "no id at all", "s1"), (None, "no id at all", "s1"), (9000, None, "s2"), (9001, "", None), (9002, "a b\x0bc\x85d", None), (9003, "long " * 30_000, "s3"), (9004, "same row", "s4"), (9004, "same row", "s4"), (9005, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"target": F.lit("x"), "goal": F.lit(1)})
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = targets_by_hand(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]} and own[0]["target"] == pytest.approx(want[s], rel=1e-12)
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) and all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, got))
    ordered = in_order(mix(docs))
    at = [r["position"] for r in ordered.collect()]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    reached = {r["doc_id"] for r in ordered.collect()}
    assert all(r["doc_id"] in reached for r in got if r["taken"])
    assert mix(docs.limit(0)).count() == 0


def test_schedules_shape_the_order(spark):
    """A source whose weight falls comes early, one whose weight rises late."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    mean = {r["source"]: r["m"] for r in in_order(mix(docs)).groupBy("source").agg(F.avg("position").alias("m")).collect()}
    assert mean["s0"] < mean["s1"] - 0.02 < mean["s2"] - 0.04


def test_crowds_without_id(spark):
    """Equal rows without id get places of their own, all over the order, and reruns agree."""
    rows = [(None, "same text here", "a")] * 900 + [(None, None, "a")] * 50 + [(i, "x y", "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"Size": F.lit("x"), "__md5": F.lit("y")})
    seen = []
    for parts in (3, 7):
        got = mix(docs.repartition(parts)).collect()
        assert len(got) == len(rows) and {r["__md5"] for r in got} == {"y"}
        alike = [r["positions"][0] for r in got if r["text"] == "same text here"]
        assert len(set(alike)) == 900 and max(alike) > 0.5 > min(alike)
        seen.append(sorted((str(r["doc_id"]), str(r["text"]), r["taken"], r["positions"]) for r in got))
    assert seen[0] == seen[1]
