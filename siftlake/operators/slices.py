"""The bit-sliced index: rows get dense ids, and 64 rows share one word for each bit of their filters.

Tables: ids(key, idx), slices(block, bit, word), busy(block, word): which ids are live.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.filters import adjust, bits_of, bits_of_bytes, bytes_of_bits
from siftlake.functions.shape import Shape


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _range_of(by: str, cuts: list) -> Column:
    """The number of ``cuts`` below the value: a binary search, written out as nested conditions."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        cut = f"{cuts[mid]}L" if isinstance(cuts[mid], int) else f"{cuts[mid]!r}D"
        return f"IF(`{by}` <= {cut}, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    return F.expr(tree(0, len(cuts)))


def ranked(df: DataFrame, by: str, ranges: int = 128) -> DataFrame:
    """Add idx, 0, 1, 2 ... in the order of the column ``by``, whose values are unique; a null comes first.

    Rows are numbered within ranges of ``by`` and moved up by the rows of earlier ranges, so no task sees all rows.
    Ranges of numbers, dates and times end at approximate quantiles. Text and bytes have no such order: theirs is that
    of a hash, by whose prefixes they are cut.
    """
    kind = df.schema[by].dataType.typeName()
    if kind in ("long", "integer", "short", "byte", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz", "decimal"):
        number = F.unix_date(by) if kind == "date" else F.col(by).cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col(by).cast("double") if kind == "decimal" else F.col(by).cast("int") if kind == "boolean" else F.col(by)
        df = df.withColumn("__number", number)  # in the order of ``by``, if not always apart
        cuts = df.agg(F.percentile_approx("__number", [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first()["c"] or []
        part, order = _range_of("__number", sorted(set(cuts))), [F.col(by)]
    else:
        part = F.conv(F.substring(F.md5(F.col(by).cast("string").cast("binary")), 1, 3), 16, 10).cast("int")
        order = [F.md5(F.col(by).cast("string").cast("binary")), F.col(by)]
    rows = df.withColumn("__part", F.when(F.col(by).isNull(), F.lit(-1)).otherwise(part)).drop("__number")
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))  # as many rows as ranges
    numbered = rows.join(F.broadcast(starts), "__part").withColumn("idx", F.col("__start") + F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1)
    return numbered.drop("__part", "__start")


def slices(filters: DataFrame, data: str = "filter", idx: str = "idx") -> DataFrame:
    """Transpose filters: for each block of 64 ids and each bit that any of them has, the word of those that do."""
    bits = filters.select((F.col(idx) / 64).cast("long").alias("block"), (F.col(idx) % 64).alias("at"), F.explode(bits_of(F.col(data))).alias("bit"))
    return bits.groupBy("block", "bit").agg(F.bit_or(_bit(F.col("at"))).alias("word"))


def busy(ids: DataFrame, idx: str = "idx") -> DataFrame:
    return ids.groupBy((F.col(idx) / 64).cast("long").alias("block")).agg(F.bit_or(_bit(F.col(idx) % 64)).alias("word"))


def ids_in(words: DataFrame) -> DataFrame:
    """idx of every set bit of (block, word)."""
    each = words.select("block", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
    return each.where(F.getbit("word", "at") == 1).select((F.col("block") * 64 + F.col("at")).alias("idx"))


def search(matrix: DataFrame, live: DataFrame, target: bytes, shape: Shape, zero_target: str = "all") -> DataFrame:
    """Live ids whose filters contain ``target``: the AND of the target's slices, 64 rows a word.

    Bits from m on are ignored; shorter targets end in zeros, longer ones raise. A block counts if it has a word for
    every bit, since a missing slice is all zero. A target without bits finds all live ids, or none.
    """
    bits = [b for b in bits_of_bytes(adjust(target, shape)) if b < shape.m]
    if not bits:
        return ids_in(live if zero_target == "all" else live.where(F.lit(False)))
    found = matrix.where(F.col("bit").isin(bits)).groupBy("block").agg(F.bit_and("word").alias("w"), F.count(F.lit(1)).alias("n"))
    found = found.where((F.col("n") == len(bits)) & (F.col("w") != 0))
    both = found.join(live, "block").select("block", F.col("w").bitwiseAND(F.col("word")).alias("word"))
    return ids_in(both.where("word <> 0"))


def resolve(found: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of ids; ids that have none any more are left out."""
    return ids.join(found, "idx", "left_semi").select(*key)


def filters_back(matrix: DataFrame) -> DataFrame:
    """(idx, bit) of the matrix: the inverse of :func:`slices`."""
    each = matrix.select("block", "bit", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
    return each.where(F.getbit("word", "at") == 1).select((F.col("block") * 64 + F.col("at")).alias("idx"), "bit")


def allocate(live: DataFrame | None, new: DataFrame, by: str, ranges: int = 128, words: DataFrame | None = None) -> DataFrame:
    """(by, idx) for new keys: the lowest ids not in live(idx), in the order of ``by``, then ids after the highest.

    ``words``: the busy words (block, word) of the live ids, where they are known.

    The n-th new key takes the n-th free id. A free id's number is the free ids of earlier groups of 4096 blocks, of
    earlier blocks of its group, and of its own word before it, so no task counts them all.
    """
    words = busy(live) if words is None else words
    held = words.agg(F.coalesce(F.max("block") + 1, F.lit(0)).alias("blocks"), F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).alias("live")).first()
    top, many = held["blocks"], held["blocks"] * 64 - held["live"]
    blocks = new.sparkSession.range(top).select(F.col("id").alias("block")).join(words, "block", "left")
    free = blocks.select("block", (F.col("block") / 4096).cast("long").alias("group"), F.bitwise_not(F.coalesce("word", F.lit(0).cast("long"))).alias("word")).withColumn("n", F.bit_count("word"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = free.groupBy("group").agg(F.sum("n").alias("n")).select("group", earlier(W.orderBy("group")).alias("before"))
    starts = free.withColumn("within", earlier(W.partitionBy("group").orderBy("block"))).join(groups, "group")
    clear = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("word", i) == 1)
    numbered = starts.select("block", (F.col("before") + F.col("within")).alias("start"), F.posexplode(clear).alias("pos", "at"))
    numbered = numbered.select((F.col("start") + F.col("pos")).alias("idx"), (F.col("block") * 64 + F.col("at")).alias("free"))
    out = ranked(new, by, ranges).join(numbered, "idx", "left")
    return out.select(by, F.coalesce("free", F.lit(top * 64 - many) + F.col("idx")).alias("idx"))


def cardinality(words: DataFrame) -> DataFrame:
    """Live ids, and the capacity of the table in ids."""
    return words.agg(F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("long").alias("live"), F.coalesce((F.max("block") + 1) * 64, F.lit(0)).cast("long").alias("capacity"))


class SlicedTable:
    """Filters under ids of their own, with the operations of an in-memory bit-sliced table; every one gives a new table."""

    def __init__(self, spark, shape: Shape, ids: DataFrame | None = None):
        self.spark, self.shape = spark, shape
        self.rows = ids if ids is not None else spark.createDataFrame([], "idx long, filter binary, deleted boolean")

    def _next(self, rows: DataFrame) -> SlicedTable:
        return SlicedTable(self.spark, self.shape, rows)

    def add(self, *bits: Sequence[int]) -> tuple[SlicedTable, list[int]]:
        """Each filter, given by its bits, gets the lowest free id."""
        new = self.spark.createDataFrame([(i, bytearray(bytes_of_bits(b, self.shape))) for i, b in enumerate(bits)], "n long, filter binary")
        live = self.rows.where("not deleted")
        given = allocate(live.select("idx"), new.select("n"), "n").join(new, "n").select("idx", "filter", F.lit(False).alias("deleted"), "n")
        at = [r["idx"] for r in given.orderBy("n").collect()]  # one for each argument
        rest = self.rows.where(~F.col("idx").isin(at))
        return self._next(rest.unionByName(given.drop("n"))), at

    def update(self, idx: int, bits: Sequence[int]) -> SlicedTable:
        data = F.when(F.col("idx") == idx, F.lit(bytearray(bytes_of_bits(bits, self.shape)))).otherwise(F.col("filter"))
        return self._next(self.rows.withColumn("filter", data))

    def delete(self, idx: int) -> SlicedTable:
        """The bits stay; the busy table hides them."""
        return self._next(self.rows.withColumn("deleted", F.col("deleted") | (F.col("idx") == idx)))

    def search(self, bits: Sequence[int]) -> list[int]:
        found = search(slices(self.rows), busy(self.rows.where("not deleted")), bytes_of_bits(bits, self.shape), self.shape)
        return sorted(r["idx"] for r in found.collect())

    def count(self) -> int:
        return self.rows.where("not deleted").count()

    def max_index(self) -> int:
        """Capacity in ids."""
        return cardinality(busy(self.rows)).first()["capacity"]

    def entries(self) -> DataFrame:
        """idx, deleted, filter; an entry that can't be read counts as deleted."""
        return self.rows.select("idx", F.coalesce("deleted", F.lit(True)).alias("deleted"), "filter")

    def drop(self) -> SlicedTable:
        return self._next(self.rows.where(F.lit(False)))
