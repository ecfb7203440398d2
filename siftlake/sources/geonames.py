"""Records of a gazetteer: 19 tab-separated text fields, and the filter of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions.shape import Shape
from siftlake.operators.items import geoname_items, with_filter

#: The fields in order.
FIELDS = ("geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature_class", "feature_code", "country_code", "cc2", "admin1_code", "admin2_code", "admin3_code", "admin4_code", "population", "elevation", "dem", "timezone", "modification_date")
SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
#: What published filters of such records have: ten items at one false positive in two millions.
SHAPE = Shape.from_np(10, 1 / 2_000_000)


def read_tsv(spark: SparkSession, path: str, limit: int | None = None, strict: bool = True) -> DataFrame:
    """Records of a file or folder. A line of too few fields is an error, or left out if not ``strict``."""
    lines = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    enough = F.size("f") >= len(FIELDS)
    if strict:
        lines = lines.select(F.when(enough, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("line too short: "), F.array_join("f", " "))).cast("array<string>")).alias("f"))
    else:
        lines = lines.where(enough)
    out = lines.select(*[F.col("f")[i].alias(name) for i, name in enumerate(FIELDS)])
    return out if limit is None else out.limit(limit)


def write_tsv(records: DataFrame, path: str) -> None:
    records.select(F.concat_ws("\t", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in FIELDS]).alias("value")).write.text(path)


def with_filters(records: DataFrame, shape: Shape = SHAPE, hashed: str = "murmur") -> DataFrame:
    items = geoname_items(*[F.col(c) for c in ("name", "asciiname", "feature_code", "country_code", "alternatenames")])
    return with_filter(records, items, shape, hashed)


def by_id(table: DataFrame, geonameid: str) -> DataFrame:
    """Point query by primary key, pushed down to the scan."""
    return table.where(F.col("geonameid") == geonameid)


def load(spark: SparkSession, tsv: str, base: str, index: str | None = None, limit: int | None = None) -> DataFrame:
    """Bulk load: records with filters to ``base``, and the chunk index, partitioned by position, to ``index``."""
    from siftlake.operators.chunks import chunks

    with_filters(read_tsv(spark, tsv, limit)).write.mode("overwrite").parquet(base)
    table = spark.read.parquet(base)
    if index:
        chunks(table, ["geonameid"]).repartition("position").sortWithinPartitions("position", "code").write.mode("overwrite").partitionBy("position").parquet(index)
    return table
