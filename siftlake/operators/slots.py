"""Metadata of a slab table: slots with flags and sizes, the search for a free one, and the chain from id to key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.operators.slices import ranked

#: Bits of a slot's flags.
DELETED, UNINITIALISED = 1, 2


def with_state(slots: DataFrame) -> DataFrame:
    """Add deleted, uninitialised, invalid (an allocation under its length) and available to (block, flags, offset, len, alloc)."""
    bit = lambda b: F.col("flags").bitwiseAND(b) == b
    out = slots.withColumns({"deleted": bit(DELETED), "uninitialised": bit(UNINITIALISED), "invalid": F.col("alloc") < F.col("len")})
    return out.withColumn("available", F.col("deleted") & ~F.col("uninitialised") & ~F.col("invalid"))


def best_fit(slots: DataFrame, size: Column | int) -> DataFrame:
    """The available slot of the smallest allocation that holds ``size``, then of the smallest block; none if nothing fits."""
    return with_state(slots).where(F.col("available") & (F.col("alloc") >= size)).orderBy("alloc", "block").limit(1)


def key_chain(ids: DataFrame, slots: DataFrame, keys: DataFrame) -> DataFrame:
    """idx to slot to key bytes: twelve columns as text would show them; what is missing stays null.

    ids(idx, initialised, reference), slots(block, flags, offset, len, alloc), keys(block, key).
    """
    chain = ids.join(with_state(slots), ids["reference"] == slots["block"], "left").join(keys, "block", "left")
    return chain.select(
        F.col("idx").alias("index"), F.col("initialised").alias("initialized"), "reference", (~F.coalesce("uninitialised", F.lit(True))).alias("idx_init"), F.coalesce("available", F.lit(False)).alias("available"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("invalid", F.lit(False)).alias("invalid"), F.col("len").alias("used"), F.col("alloc").alias("allocated"), "offset",
        F.hex("key").alias("hex"), F.col("key").cast("string").alias("char"),
    )


def get(ids: DataFrame, slots: DataFrame, keys: DataFrame) -> DataFrame:
    """(idx, key) of the ids whose slots hold one: initialised, not deleted."""
    whole = key_chain(ids, slots, keys).where("initialized and idx_init and not deleted and hex is not null")
    return whole.select(F.col("index").alias("idx"), F.unhex("hex").alias("key"))


def matching(ids: DataFrame, idx: int, reference: int | None) -> DataFrame:
    """Map entries of the same block, of the same reference, or uninitialised as the one sought is."""
    same = (F.col("idx") == idx) | F.coalesce(F.col("reference") == F.lit(reference), F.lit(False))
    return ids.where(same | (~F.col("initialised") & F.lit(reference is None)))


def place(slots: DataFrame, keys: DataFrame, block: int | None, key: bytes) -> tuple[DataFrame, DataFrame, int]:
    """Store a key: in its own slot if it fits, else in the best fitting free one, else in a new one; the old is freed.

    Returns slots, keys and the block used. One key at a time, as the slab table does, by one read of the driver: the own
    slot, the best fit and the ends come in one row. Many keys at once go through :func:`load`.
    """
    state = with_state(slots)
    fits = F.col("available") & (F.col("alloc") >= len(key))
    at_own = F.col("block") == F.lit(block).cast("long")
    seen = state.agg(F.max(F.when(at_own, F.col("alloc"))).alias("own"), F.min(F.when(fits, F.struct("alloc", "block")))["block"].alias("fit"), F.coalesce(F.max("block") + 1, F.lit(0)).alias("next"), F.coalesce(F.max(F.col("offset") + F.col("alloc")), F.lit(0)).alias("end")).first()
    if seen["own"] is not None and seen["own"] >= len(key):
        at = block
    else:
        at = seen["next"] if seen["fit"] is None else seen["fit"]
        if seen["fit"] is None:
            new = slots.sparkSession.createDataFrame([(at, 0, seen["end"], len(key), len(key))], "block long, flags int, offset long, len long, alloc long")
            slots = slots.select("block", "flags", "offset", "len", "alloc").unionByName(new)
        if seen["own"] is not None:
            slots = slots.withColumn("flags", F.when(F.col("block") == block, F.col("flags").bitwiseOR(DELETED)).otherwise(F.col("flags")))
    here = F.col("block") == at
    slots = slots.withColumns({"flags": F.when(here, F.lit(0)).otherwise(F.col("flags")), "len": F.when(here, F.lit(len(key))).otherwise(F.col("len"))})
    row = keys.sparkSession.createDataFrame([(at, bytearray(key))], "block long, key binary")
    return slots, keys.where(F.col("block") != at).unionByName(row), at


def load(new: DataFrame, by: str = "idx", key: str = "key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (ids, slots, keys) of many keys, one slot each, in the order of the column ``by``.

    Blocks are numbered, and offsets summed up, within ranges first, so no task sees all keys.
    """
    rows = ranked(new, by).select(F.col(by).alias("idx"), F.col("idx").alias("block"), F.col(key).alias("key"), F.octet_length(key).cast("long").alias("len")) if by != "idx" else ranked(new.withColumnRenamed("idx", "__id"), "__id").select(F.col("__id").alias("idx"), F.col("idx").alias("block"), F.col(key).alias("key"), F.octet_length(key).cast("long").alias("len"))
    rows = rows.withColumn("group", (F.col("block") / 65536).cast("long"))
    earlier = lambda w: F.coalesce(F.sum("len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = rows.groupBy("group").agg(F.sum("len").alias("len")).select("group", earlier(W.orderBy("group")).alias("before"))
    placed = rows.withColumn("offset", earlier(W.partitionBy("group").orderBy("block"))).join(groups, "group").withColumn("offset", F.col("before") + F.col("offset"))
    return placed.select("idx", F.lit(True).alias("initialised"), F.col("block").alias("reference")), placed.select("block", F.lit(0).alias("flags"), "offset", "len", F.col("len").alias("alloc")), placed.select("block", "key")


def delete(ids: DataFrame, slots: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, slots) after the ids of ``gone`` were deleted: their slots are free, their entries point nowhere."""
    marked = ids.join(gone.select("idx", F.lit(True).alias("__gone")), "idx", "left").withColumn("__gone", F.coalesce("__gone", F.lit(False)))
    freed = marked.where("__gone and initialised and reference is not null").select(F.col("reference").alias("block"), F.lit(DELETED).alias("__free")).distinct()
    left = marked.select("idx", (F.col("initialised") & ~F.col("__gone")).alias("initialised"), F.when(~F.col("__gone"), F.col("reference")).alias("reference"))
    flags = F.col("flags").bitwiseOR(F.coalesce("__free", F.lit(0)))
    return left, slots.join(freed, "block", "left").withColumn("flags", flags).drop("__free")


def free_list(slots: DataFrame) -> DataFrame:
    """The available slots as they would be tried, rebuilt from the table: the smallest allocation first, then the smallest block."""
    return with_state(slots).where("available").select("block", "alloc").orderBy("alloc", "block")
