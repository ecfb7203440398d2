"""The chunk index: one row (position, code, key) for each non-zero byte of a filter, and searches over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.filters import bits_of_bytes, byte_at, codes


def chunks(df: DataFrame, key: Sequence[str], data: str = "filter") -> DataFrame:
    """Index rows of every filter; null filters and zero bytes have none. A projection and a generator: no shuffle."""
    return df.select(*key, F.posexplode(codes(F.col(data))).alias("position", "code")).where("code <> 0")


def target_chunks(target: bytes) -> list[tuple[int, int]]:
    """(position, code) of a target's non-zero bytes, the most selective first, then by position."""
    found: dict[int, int] = {}
    for b in bits_of_bytes(target):
        found[b // 8] = found.get(b // 8, 0) | 1 << (b % 8)
    return sorted(found.items(), key=lambda x: (-selectivity_of(x[1]), x[0]))


def selectivity_of(code: int) -> int:
    """Non-zero codes that ``code`` contains."""
    return (1 << code.bit_count()) - 1


def selectivity(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.bit_count(code).cast("int")) - 1


def superset_codes(code: int, zero: bool = False) -> list[int]:
    """The byte codes that contain ``code``; with ``zero`` also for code 0, as the client table has it."""
    return [j for j in range(0 if zero else 1, 256) if j & code == code] if code or zero else []


def ordered(keys: DataFrame) -> DataFrame:
    """Query keys (position, code) with their selectivity and rank: the most selective first, then by position."""
    rated = keys.withColumn("selectivity", selectivity(F.col("code")))
    return rated.withColumn("rank", F.row_number().over(W.orderBy(F.desc("selectivity"), "position")))


#: Fixed value: how a key is written as text.
KEY_TEXT = "IndexKey[%d, 0x%02x]"


def key_text(position: Column, code: Column) -> Column:
    return F.format_string(KEY_TEXT, position, code)


def entries(index: DataFrame, position: int, code: int | None = None) -> DataFrame:
    """Index rows of one position, or of one (position, code): both reach the scan as predicates."""
    rows = index.where(F.col("position") == position)
    return rows if code is None else rows.where(F.col("code") == code)


def index_value(key: Sequence[str]) -> Column:
    """Position, code and key as one value."""
    return F.struct("position", "code", *key)


def key_bytes(position: Column, code: Column) -> Column:
    """Position and code as two big-endian integers."""
    return F.unhex(F.concat(F.lpad(F.hex(position), 8, "0"), F.lpad(F.hex(code), 8, "0")))


def _none(index: DataFrame, key: Sequence[str]) -> DataFrame:
    return index.select(*key).where(F.lit(False))


def search(index: DataFrame, key: Sequence[str], target: bytes, zero_target: str = "none", base: DataFrame | None = None) -> DataFrame:
    """Keys whose filters contain ``target``, each once: those with a fitting code at each of the target's positions.

    The target is a constant, so the condition is one filter at the scan: positions as an IN list, which prunes
    partitions and row groups, and a bitwise test of codes. One aggregate with partial counts follows. A target
    without bits finds nothing, or with ``zero_target='all'`` every key of ``base``.

    Hits are sets, as a Bloom index must never miss: a key with several index rows at a position, as of a row written
    twice, counts there once. A ``key`` that is a part of the index's key, such as that of a whole partition, is found
    if its rows together fit every position, maybe different ones at different positions.
    """
    parts = target_chunks(target)
    if not parts:
        return _none(index, key) if zero_target == "none" else (base if base is not None else index).select(*key).distinct()
    at = index.where(F.col("position").isin([p for p, _ in parts]))
    if len(parts) > 63:  # too many for a condition each: their codes stand in a constant, by position
        asked = dict(parts)
        need = byte_at(F.lit(bytearray(asked.get(p, 0) for p in range(max(asked) + 1))), F.col("position"))
        hits = at.where(F.col("code").bitwiseAND(need) == need)
        return _divided(hits, key, "position").where(F.col("n") == len(parts)).select(*key)
    fits, met = F.lit(False), F.lit(0).cast("long")
    for p, c in parts:
        fits = fits | ((F.col("position") == p) & (F.col("code").bitwiseAND(c) == c))
    hits = at.where(fits)
    for i, (p, _) in enumerate(parts):
        met = F.when(F.col("position") == p, F.lit(1 << i).cast("long")).otherwise(met)
    return hits.groupBy(*key).agg(F.bit_or(met).alias("met")).where(F.col("met") == (1 << len(parts)) - 1).select(*key)


def _divided(hits: DataFrame, key: Sequence[str], position: str, *more: Column) -> DataFrame:
    """Distinct positions of each key as n. One shuffle by the key serves both steps."""
    once = hits.repartition(*key).dropDuplicates([*key, position])
    return once.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *more)


def search_chain(index: DataFrame, key: Sequence[str], target: bytes, zero_target: str = "none", base: DataFrame | None = None) -> DataFrame:
    """The same as a chain of semi joins in the order of selectivity.

    Each step reads one position and only supersets of its code. The survivors so far are the join's right side, where
    the engine's runtime Bloom filter gates the next read; an empty step ends the chain by adaptive execution.
    """
    parts = target_chunks(target)
    if not parts:
        return search(index, key, target, zero_target, base)
    out = None
    for p, c in parts:
        step = index.where((F.col("position") == p) & F.col("code").isin(superset_codes(c))).select(*key)
        out = step if out is None else step.join(out, list(key), "left_semi")
    return out.distinct()


def expanded_targets(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """(query_id, position, code, parts): the codes that contain each target chunk, as rows for an equi-join."""
    own = chunks(targets, ["query_id"], "target")
    parts = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("parts"))
    supersets = F.filter(F.sequence(F.lit(1), F.lit(255)), lambda j: j.bitwiseAND(F.col("code")) == F.col("code"))
    return own.join(parts, "query_id").select("query_id", "position", "parts", F.explode(supersets).alias("code"))


def search_many(index: DataFrame, key: Sequence[str], targets: DataFrame) -> DataFrame:
    """(query_id, key) for many targets (query_id, target) at once.

    Codes are expanded on the side of the targets, so index rows meet them by an equi-join on (position, code), which
    hashes over 255 codes a position where the bare position would make a few large groups, and which adaptive
    execution broadcasts or splits by measured size. Relational division by counting follows.
    """
    wanted = expanded_targets(index.sparkSession, targets)
    hits = index.join(wanted, ["position", "code"]).select("query_id", *key, "position", "parts")
    return _divided(hits, ["query_id", *key], "position", F.first("parts").alias("parts")).where("n = parts").select("query_id", *key)


def fetch(base: DataFrame, hits: DataFrame, key: Sequence[str], residual: Column | None = None) -> DataFrame:
    """Base rows of the keys found, each once, after the predicates that the index didn't answer."""
    rows = base if residual is None else base.where(residual)
    return rows.join(hits, list(key), "left_semi")


def search_verified(base: DataFrame, index: DataFrame, key: Sequence[str], target: bytes, exact: Column) -> DataFrame:
    """Candidates without the false positives: the exact predicate on the rows that the filters let pass."""
    return fetch(base, search(index, key, target), key, exact)


def code_histogram(index: DataFrame) -> DataFrame:
    return index.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def chunk_statistics(index: DataFrame, key: Sequence[str]) -> DataFrame:
    """Total, mean, least and most of the non-zero bytes of filters."""
    each = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))
