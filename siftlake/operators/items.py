"""From rows to filters: which items a row has, and filters made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.filters import filter_of_bits
from siftlake.functions.hashing import java_trim, md5_bits, murmur_bits
from siftlake.functions.shape import Shape

HASHES = {"md5": md5_bits, "murmur": murmur_bits}


def words(text: Column) -> Column:
    """Items of a phrase: split at single spaces; trailing empty parts don't count."""
    parts = F.split(text, " ", -1)
    return F.filter(parts, lambda w: java_trim(w) != "")


def geoname_items(name: Column, asciiname: Column, feature_code: Column, country_code: Column, alternatenames: Column, most: int = 10) -> Column:
    """Names, codes, and the first ``most`` alternate names."""
    return F.filter(F.concat(F.array(name, asciiname, feature_code, country_code), F.slice(F.split(alternatenames, ","), 1, most)), lambda x: x.isNotNull())


def with_filter(df: DataFrame, items: Column, shape: Shape, hashed: str = "md5", to: str = "filter") -> DataFrame:
    """Add the filter of an array of items, made within the row."""
    clean = F.transform(items, java_trim) if hashed == "md5" else items
    bits = df.withColumn("__bits", HASHES[hashed](clean, shape))  # apart, since a Python function can't stand in a lambda
    return bits.withColumn(to, filter_of_bits(F.col("__bits"), shape)).drop("__bits")


def chunks_of_items(df: DataFrame, key: list[str], items: Column, shape: Shape) -> DataFrame:
    """(key, position, code) straight from items, for rows of very many: bits are merged by OR in partial aggregates."""
    bits = df.select(*key, F.explode(md5_bits(F.array_distinct(items), shape)).alias("bit"))  # a word is hashed once a row
    each = bits.select(*key, (F.col("bit") / 8).cast("int").alias("position"), F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int")).alias("c"))
    return each.groupBy(*key, "position").agg(F.bit_or("c").alias("code"))


def merged(df: DataFrame, key: list[str], data: str = "filter") -> DataFrame:
    """One filter per key: the OR of its rows' filters, word by word."""
    from siftlake.functions.filters import decode_words

    rows = df.select(*key, F.posexplode(decode_words(F.col(data))).alias("w", "word")).groupBy(*key, "w").agg(F.bit_or("word").alias("word"))
    listed = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("w", "word"))).alias("words"))  # a filter's words
    return listed.select(*key, F.unhex(F.concat_ws("", F.transform("words", lambda x: F.lpad(F.hex(x["word"]), 16, "0")))).alias(data))
