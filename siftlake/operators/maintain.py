"""Keeping an index in step with its base table. Tables are values: each operation gives the next version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.operators.chunks import chunks


def latest(mutations: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last mutation of each key by the columns ``order``: a maximum with partial aggregates, not a window."""
    rest = [c for c in mutations.columns if c not in key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("__last")
    return mutations.groupBy(*key).agg(best).select(*key, *[F.col(f"__last.{c}").alias(c) for c in [*order, *rest]])


def live(rows: DataFrame, now: Column, written: str = "ts", ttl: str = "ttl") -> DataFrame:
    """Rows that haven't expired: without a ttl, or written less than ttl seconds before ``now``."""
    end = F.unix_timestamp(F.col(written)) + F.col(ttl)
    return rows.where(F.col(ttl).isNull() | (end > F.unix_timestamp(now)))


def diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Index rows to delete and insert (op) that lead from one version of filters to another, byte by byte.

    A null filter has no rows, so a filter that appears is all inserts and one that goes is all deletes.
    """
    both = [*key, "position", "code"]
    a, b = chunks(old, key), chunks(new, key)
    return a.join(b, both, "left_anti").select(*both, F.lit("delete").alias("op")).union(b.join(a, both, "left_anti").select(*both, F.lit("insert").alias("op")))


def apply_diff(index: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    both = [*key, "position", "code"]
    kept = index.select(*both).join(changes.where("op = 'delete'").select(*both), both, "left_anti")
    return kept.unionByName(changes.where("op = 'insert'").select(*both).join(kept, both, "left_anti"))


def upsert(index: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Index after ``rows`` (key, filter) were written: whatever a written key had goes, so no stale bit stays.

    A key that ``rows`` repeats gets the OR of its filters, one index row a position.
    """
    new = chunks(rows, key).groupBy(*key, "position").agg(F.bit_or("code").alias("code"))
    return index.join(rows.select(*key), list(key), "left_anti").unionByName(new.select(*index.columns))


def delete(index: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Index without the rows of ``keys``. ``key`` may be a part of the index's key, as for a whole partition."""
    return index.join(keys.select(*key), list(key), "left_anti")


def delete_range(index: DataFrame, condition: Column) -> DataFrame:
    """Index without the keys for which the condition holds; nulls stay."""
    return index.where(~F.coalesce(condition, F.lit(False)))


def release(busy: DataFrame, gone: DataFrame) -> DataFrame:
    """Busy words after the ids ``gone`` were deleted; slices may keep their bits."""
    masks = gone.groupBy((F.col("idx") / 64).cast("long").alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("idx") % 64).cast("int"))).alias("mask"))
    left = busy.join(masks, "block", "left")
    return left.select("block", F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0).cast("long")))).alias("word"))


def unique_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key, where reads of several partitions may meet it again."""
    return df.dropDuplicates(list(key))


def versions(mutations: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All mutations with the filter that each replaced, for audits."""
    return mutations.withColumn("before", F.lag("filter").over(W.partitionBy(*key).orderBy(*order)))
