"""The small dataflow vocabulary: lazy plans in, lazy plans out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def map_with(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def filter_keep(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def filter_drop(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition doesn't hold, unknown ones too."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def and_then(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, one after another, repeats included."""
    return reduce(DataFrame.unionAll, frames)


def flatten(df: DataFrame, column: str) -> DataFrame:
    """A row for each element of an array."""
    return df.select(*[F.explode(column).alias(column) if c == column else c for c in df.columns])


def map_filter(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Mapped rows without those that map to null."""
    return df.select(value.alias(name)).where(F.col(name).isNotNull())


def unique(df: DataFrame) -> DataFrame:
    return df.distinct()


def random_order(df: DataFrame, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def singleton(spark: SparkSession, row: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame([row], schema)


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that tells their number once they have been read."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("count")), seen


def next_row(df: DataFrame):
    """The first row or None."""
    found = df.head(1)
    return found[0] if found else None
