"""Mixing sources to target weights along a curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm.common import adds, materialise, read

#: Words of every contract here.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, slopes=(-0.5, 0.0, 0.5)) -> DataFrame:
    """One row per source of ``sizes`` (__src, source, source_size) with its target, in words, and its slope.

    Targets share ``share`` times all words by weight; one above ``cap`` times its source's size stops there and the
    excess is shared again. Sorted by cap / weight, the stopped sources come first, so one running sum finds them.
    It works in one task, on one pre-aggregated row per source.
    """
    by_name, everything = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("__rank") % len(values) + 1).cast("int"))
    out = sizes.withColumn("__rank", F.row_number().over(by_name) - 1)
    out = out.withColumns({"__w": pick(weights, "long"), "slope": pick(slopes, "double"), "__cap": F.col("source_size") * cap, "__due": F.sum("source_size").over(everything) * F.lit(share)})
    out = out.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    order = W.orderBy("__ratio", "__rank")
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing))
    out = out.withColumn("__full", F.col("__ratio") <= (F.col("__due") - before) / weight_left)
    out = out.withColumns({"__taken": F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0)).over(everything), "__open": F.sum(F.when(F.col("__full"), 0).otherwise(F.col("__w"))).over(everything)})
    level = F.col("__w") * (F.col("__due") - F.col("__taken")) / F.nullif(F.col("__open"), F.lit(0))
    return out.select("__src", "source_size", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(level).alias("target"), "slope")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Add __md5, the order of a source's documents: the MD5 of the id, or for rows without one of their text and a number.

    Rows without id that share a text are numbered within the parts of a written table and moved up by the rows of
    earlier parts, so that a crowd of them is dealt evenly, whatever its size, and no task numbers it whole.
    """
    named = docs.where(F.col(doc_id).isNotNull()).withColumn("__md5", F.md5(F.col(doc_id).cast("string").cast("binary")))
    alone = docs.where(F.col(doc_id).isNull()).withColumns({"__md5": F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), "__at": F.monotonically_increasing_id()})
    alone = materialise(alone.withColumn("__part", F.shiftright("__at", 33)), "mix-nameless")
    if alone.isEmpty():
        return named
    earlier = W.partitionBy("__md5").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as parts
    parts = alone.groupBy("__md5", "__part").agg(F.count(F.lit(1)).alias("n")).select("__md5", "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.row_number().over(W.partitionBy("__md5", "__part").orderBy("__at"))
    alone = alone.join(materialise(parts, "mix-parts"), ["__md5", "__part"]).withColumn("__n", number)
    return named.unionByName(alone.withColumn("__md5", F.md5(F.concat_ws(":", "__md5", F.col("__n").cast("string")).cast("binary"))).drop("__at", "__part", "__before", "__n"))


@adds("size", "source_size", "target", "taken", "positions")
def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=(3, 1, 2), share: float = 1.5, cap: int = 2, slopes=(-0.5, 0.0, 0.5)) -> DataFrame:
    """Give every document the words that the mix takes of it and its training positions.

    Adds size (words; null text has none), source_size, target (words of its source), taken (words, repeats counted)
    and positions, one for each copy: up to 1 for what the training reads, above it for copies out of reach.

    Source s asks for words at the rate target * (1 + slope * (2 t - 1)) at training time t from 0 to 1; the integral
    over time is its cumulative demand. Its documents stand in the order of md5(id), pass after pass, and the
    copy that starts at word c is read when the demand reaches c: positions are that integral's inverse. Only the
    copy at the target's edge gives part of its words. Whoever writes the mix sorts by range of the positions
    (:func:`in_order`).

    Starts are prefix sums in three steps (within one of 4096 hash ranges of a source, over 64 ranges, over 64 groups
    of ranges), so a source with a third of all rows is spread over 4096 windows. Rows pass one shuffle.

    Rows without id stand in the order of their text's hash; equal ones are interchangeable, and so reruns agree. Rows
    that repeat an id are rows of their own. A null source is a source, the last. A source without words has target 0
    and its documents positions above 1; null and empty texts have size 0 and take the position of their start. Ties in
    the hash go by id. Texts are only counted, so very long ones need no rule. Columns named as the added ones are
    replaced, others pass through. An empty table gives no rows.
    """
    out = _keyed(docs, text, doc_id)
    out = out.withColumns({"size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"), "__src": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))})
    out = out.withColumn("__bucket", F.conv(F.substring("__md5", 1, 3), 16, 10).cast("int"))
    sums = materialise(out.groupBy("__src", "__bucket").agg(F.sum("size").alias("__words"), F.first(F.col(source).cast("string")).alias("__name")), "mix-sums")
    sums = sums.withColumn("__coarse", (F.col("__bucket") / 64).cast("int"))
    earlier = lambda *keys, by: F.coalesce(F.sum("__words").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fine = sums.withColumn("__fine_start", earlier("__src", "__coarse", by="__bucket")).select("__src", "__coarse", "__bucket", "__fine_start")
    coarse = sums.groupBy("__src", "__coarse").agg(F.sum("__words").alias("__words")).withColumn("__coarse_start", earlier("__src", by="__coarse")).select("__src", "__coarse", "__coarse_start")
    totals = sums.groupBy("__src").agg(F.sum("__words").alias("source_size"), F.first("__name").alias("source"))
    plan = source_targets(totals, weights, share, cap, slopes).withColumnsRenamed({"source_size": "__total", "target": "__target", "slope": "__slope"})
    ranges = fine.join(coarse, ["__src", "__coarse"]).join(plan, "__src").select("__src", "__bucket", (F.col("__fine_start") + F.col("__coarse_start")).alias("__range_start"), "__total", "__target", "__slope")
    ranges = materialise(ranges, "mix-ranges")

    out = out.join(ranges, ["__src", "__bucket"])
    inside = W.partitionBy("__src", "__bucket").orderBy("__md5", doc_id, "size").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("__start", F.col("__range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    total, target, slope, goal = F.col("__total"), F.col("__target"), F.col("__slope"), F.floor("__target")
    zero = F.lit(0).cast("long")
    taken, positions = zero, []
    for copy in range(cap):
        start = F.col("__start") + total * copy
        taken = taken + F.greatest(zero, F.least(F.col("size"), goal - start))
        x, flat = start / target, 1 - slope
        reached = F.when(slope == 0, x).otherwise((F.sqrt(flat * flat + 4 * slope * x) - flat) / (2 * slope))
        beyond = 1 + (start - goal + 1) / F.greatest(total, F.lit(1))
        positions.append(F.when(start < goal, F.least(reached, F.lit(1.0))).otherwise(beyond))
    out = out.withColumns({"source_size": total, "target": target, "taken": taken, "positions": F.array(*positions)})
    return out.drop("__src", "__md5", "__bucket", "__range_start", "__total", "__target", "__slope", "__start")


def in_order(mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The copies that the training reads, one row each with its position, sorted by range of the position."""
    return mixed.withColumn("position", F.explode(F.filter("positions", lambda p: p <= 1))).orderBy("position", doc_id)


def op7_mixing(spark, sf_dir):
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("positions")[0].alias("position"), F.col("positions")[1].alias("position_again")).orderBy("position", "doc_id")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][(rnk % 3 + 1)::INT] AS weight, [-0.5, 0.0, 0.5][(rnk % 3 + 1)::INT]::DOUBLE AS slope,
         2 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS due FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, ratio <= (due - coalesce(sum(cap) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stopped FROM r),
t AS (
  SELECT source, source_size, slope,
         CASE WHEN stopped THEN cap::DOUBLE
              ELSE weight * (due - (sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ())::DOUBLE)
                   / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () END AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, floor(t.target)::BIGINT AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size)) AS taken,
       {} AS position, {} AS position_again
FROM p
""".format(*(f"""CASE WHEN {start} >= goal THEN 1 + ({start} - goal + 1)::DOUBLE / greatest(source_size, 1)
            WHEN slope = 0 THEN least({start} / target, 1.0)
            ELSE least((sqrt((1 - slope) * (1 - slope) + 4 * slope * ({start} / target)) - (1 - slope)) / (2 * slope), 1.0)
       END""" for start in ("start", "(start + source_size)")))
