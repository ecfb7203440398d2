"""Exact top-k by inner product: MaxScore over shards of quantised vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm.common import materialise, read

#: Rows of a shard that are scored together, and terms that are probed together.
ROWS, TERMS = 2048, 8
LONG = (-(1 << 63), (1 << 63) - 1)


def quantise(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """floor(256 * x) as doubles, shorter vectors filled with zeros; read from the flat buffer of the lists."""
    lists = column.combine_chunks()
    flat = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def maxscore(query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, k: int, at: np.ndarray | None = None, known: float = -math.inf, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a shard for one query, ties to the smaller id; the row numbered ``own`` in ``at`` (by default ids) is left out.

    ``known`` is a score that k rows elsewhere reach, so rows below it can't be among the k best of all; ``bounds`` are the
    shard's least and most in each dimension.

    A term is a dimension and its postings are the values above the shard's least contribution. Terms are ordered by
    the most that they can add to that. Once the k-th best score is known, trailing terms whose bounds together stay
    under it can't lift a row alone: they are non-essential. The essential ones are traversed for all rows, the others
    are probed a few at a time for rows that still compete.
    """
    at = ids if at is None else at
    least_of, most_of = bounds if bounds else (rows.min(0), rows.max(0))
    top, low = most_of * query, least_of * query
    upper, least = np.maximum(top, low), np.minimum(top, low)
    order = np.argsort(least - upper, kind="stable")
    rest = np.concatenate((np.cumsum(upper[order][::-1])[::-1], [0.0]))  # bound of the terms from here on
    gain = np.concatenate((np.cumsum((upper - least)[order][::-1])[::-1], [0.0]))
    base, best_ids, best, limit = least.sum(), ids[:0], np.zeros(0), known
    for a in range(0, len(rows), ROWS):
        block = rows[a : a + ROWS]
        essential = int(np.searchsorted(-gain, -(limit - base), "right")) if limit > -math.inf else len(order)
        essential = min(max(essential, 1), len(order))
        first = order[:essential]
        score = block[:, first] @ query[first]
        alive = np.flatnonzero((at[a : a + ROWS] != own) & (score + rest[essential] >= limit))
        score = score[alive]
        for t in range(essential, len(order), TERMS):
            if not len(alive):
                break
            some = order[t : t + TERMS]
            score = score + block[np.ix_(alive, some)] @ query[some]
            still = score + rest[min(t + TERMS, len(order))] >= limit
            alive, score = alive[still], score[still]
        best_ids, best = np.concatenate((best_ids, ids[a + alive])), np.concatenate((best, score))
        chosen = _best(best, best_ids, k)
        best_ids, best = best_ids[chosen], best[chosen]
        if len(best) == k:
            limit = max(limit, best[-1])
    return best_ids, best


def _exact(query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, k: int, at: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """The same in unbounded integers, for values whose sums a double can't hold; scores stop at the range of long."""
    as_int = np.frompyfunc(int, 1, 1)
    other = np.flatnonzero((ids if at is None else at) != own)
    score = as_int(rows[other]) @ as_int(query)
    chosen = sorted(range(len(other)), key=lambda i: (-score[i], ids[other[i]]))[:k]
    return ids[other[chosen]], [min(max(score[i], LONG[0]), LONG[1]) for i in chosen]


FOUND = [("asked", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]


def search_shard(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """(asked, query_id, vec_id, score): the k best of one shard for each query of a block."""
    dims = max([1, *(int(m) for t in (queries, shard) if (m := pa.compute.max(pa.compute.list_value_length(t.column("embedding"))).as_py()) is not None)])
    q, v = quantise(queries.column("embedding"), dims), quantise(shard.column("embedding"), dims)
    ids, at = (shard.column(c).to_numpy() for c in ("vec_id", "row"))
    order = np.argsort(ids, kind="stable")
    ids, at, v = ids[order], at[order], v[order]
    found: list[list] = [[], [], [], []]
    if len(q) and len(v):
        safe, bounds = np.abs(q).max() * np.abs(v).max() * dims < 2.0**52, (v.min(0), v.max(0))
        known = queries.column("known").to_pylist()
        for row, own, least, query in zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), known, q, strict=True):
            got, score = maxscore(query, row, v, ids, k, at, -math.inf if least is None else least, bounds) if safe else _exact(query, row, v, ids, k, at)
            for c, values in zip(found, ([row] * len(got), [own] * len(got), got.tolist(), map(int, score)), strict=True):
                c.extend(values)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(FOUND, found, strict=True)})


def _sound(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows that take part, with their vectors as doubles."""
    fine = F.forall(embedding, lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return df.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(fine)


def top_k(vectors: DataFrame, asks: Column | None = None, queries: DataFrame | None = None, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", most: int = 1 << 16, least: int = 1 << 11) -> DataFrame:
    """For each query the ``k`` rows of ``vectors`` of the highest inner product: query_id, rank, vec_id, score.

    The queries are the rows of ``vectors`` where ``asks`` holds, each of which leaves itself out, and those of a table
    ``queries``, which leave out none. Components are floor(256 * x), scores exact integers, ties go to the smaller id.

    Rows are numbered and dealt by number to shards and blocks of about ``most`` rows, so that a crowd of equal vectors
    is dealt evenly; fewer, down to ``least``, where there would be too few pairs of blocks for all cores. Each block of
    queries first meets one shard, which tells a score that k rows reach; with it, it meets all other shards, each pair
    in one task. A shard tells its k best, and those are merged by query. The number of pairs is the contract's; of
    N vectors and Q queries each vector is sent Q / ``most`` times and each query N / ``most`` times.

    Rows without id or vector, or with null or non-finite components take no part; shorter vectors end in zeros, an empty
    one scores 0. Repeated rows are candidates each, and queries each, under one query_id. Scores beyond a long stop at its
    range. A very long vector is one row. Empty tables give no rows. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    cast = lambda df, *more: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), *more)
    asking = (F.lit(False) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks")
    rows = materialise(cast(_sound(vectors, vec_id, embedding), asking).withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    asked = rows.where("asks").select("vec_id", "embedding", "row")
    if queries is not None:
        asked = asked.union(cast(_sound(queries, vec_id, embedding)).withColumn("row", -1 - F.monotonically_increasing_id()))
    asked = materialise(asked, "topk-queries")
    n, m, cores = rows.count(), asked.count(), 2 * spark.sparkContext.defaultParallelism
    shards = max(1, -(-n // most), min(-(-n // least), cores))
    blocks = max(1, -(-m // most), min(-(-m // least), -(-cores // shards)))
    deal = lambda df, n, to: df.withColumn(to, F.pmod(F.xxhash64("row"), F.lit(n)))
    each = lambda df, n, to, skip: df.withColumn(to, F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), skip)))
    schema = "asked long, query_id long, vec_id long, score long"

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(lambda q, s: search_shard(q, s, k), schema)

    left, right = deal(asked, blocks, "block"), deal(rows.select("vec_id", "embedding", "row"), shards, "shard")
    home = F.pmod(F.col("block"), F.lit(shards))
    first = materialise(met(left.withColumns({"shard": home, "known": F.lit(None).cast("long")}), each(right, blocks, "block", lambda b: F.pmod(b, F.lit(shards)) == F.col("shard"))), "topk-first")
    known = first.groupBy("asked").agg(F.min("score").alias("known"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(F.col("asked").alias("row"), "known")
    rest = met(each(left.join(known, "row", "left"), shards, "shard", lambda s: s != F.pmod(F.col("block"), F.lit(shards))), each(right, blocks, "block", lambda b: F.pmod(b, F.lit(shards)) != F.col("shard")))
    order = W.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
