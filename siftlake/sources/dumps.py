"""Dumps of index internals as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.filters import hex_string


def filter_rows(entries: DataFrame, indexes: list[int] | None = None) -> DataFrame:
    """index, deleted, filter as text; all entries, or those of ``indexes``."""
    rows = entries if indexes is None else entries.where(F.col("idx").isin(indexes))
    return rows.select(F.col("idx").alias("index"), F.col("deleted").cast("string").alias("deleted"), hex_string(F.col("filter")).alias("filter"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
