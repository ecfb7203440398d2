"""Exact dedup by progressive refinement: length, then prefix hash, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import adds, flag_in_filter, materialise, read, slot_filter, without_blanks


def _sized(docs: DataFrame, text: str, prefix_chars: int) -> DataFrame:
    norm = without_blanks(F.col(text))
    return docs.withColumns({"__norm": norm, "__points": F.length(F.coalesce(F.col(text), F.lit("")))}).withColumns({"__len": F.length("__norm"), "__pre": F.xxhash64(F.length("__norm"), F.substring("__norm", 1, prefix_chars))})


@adds("keep_id", "group_size", "kept", "text_sha256")
def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix_chars: int = 64, slots: int = 1 << 22, digest: bool = False) -> DataFrame:
    """Mark rows whose texts are equal once white space is deleted.

    Adds keep_id (the id that stays: most code points in the original text, then smallest id), group_size and kept;
    with ``digest`` also text_sha256 of every row's normalised text, for which whole texts have to be read anyway.

    One narrow table of lengths and prefix hashes comes from the first reading. Lengths seen once are settled by it,
    then prefixes seen once among the rest. What remains is told to the second reading by a bitmap of ``slots`` bits
    (its size does not depend on the input), and only there whole texts are hashed and grouped. Texts themselves
    never enter a shuffle unless the caller selects them from the result.

    Null text counts as empty, and empty texts are equal. A null id loses every tie. Rows which repeat both id and
    text are one document told twice: each counts in group_size, and they share one decision. A very long text is
    normalised and hashed within its row. Extra columns pass through; columns named as the added ones are replaced. An
    empty table gives no rows.
    """
    sizes = materialise(_sized(docs, text, prefix_chars).select("__len", "__pre"), "dedup-sizes")
    lengths = sizes.groupBy("__len").count().where("count > 1")
    same_length = flag_in_filter(sizes, "__len", slot_filter(lengths, "__len", slots), slots, "__maybe").where("__maybe")
    prefixes = same_length.groupBy("__pre").count().where("count > 1")
    survivors = materialise(slot_filter(prefixes, "__pre", slots), "dedup-prefixes")

    hashed = flag_in_filter(_sized(docs, text, prefix_chars), "__pre", survivors, slots, "__maybe")
    whole = F.sha2(F.col("__norm").cast("binary"), 256)
    hashed = hashed.withColumn("__sha", whole if digest else F.when(F.col("__maybe"), whole))
    hashed = hashed.withColumn("__key", F.when(F.col("__maybe"), F.col("__sha")).otherwise(F.hex("__pre")))
    best = F.min(F.struct((-F.col("__points")).alias("p"), F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("id")))
    groups = hashed.where("__maybe").groupBy("__key").agg(best.alias("__best"), F.count(F.lit(1)).alias("__size")).where("__size > 1")
    groups = materialise(groups.select(F.col("__key").alias("__group"), F.col("__best.id").alias("__keep"), "__size"), "dedup-groups")

    out = hashed.join(groups, hashed["__key"] == groups["__group"], "left")
    alone = F.col("__size").isNull()
    out = out.withColumns({"keep_id": F.when(alone, F.col(doc_id)).otherwise(F.col("__keep")), "group_size": F.coalesce("__size", F.lit(1).cast("long"))})
    out = out.withColumn("kept", alone | F.col("keep_id").eqNullSafe(F.col(doc_id)))
    if digest:
        out = out.withColumn("text_sha256", F.col("__sha"))
    return out.drop("__sha", "__norm", "__points", "__len", "__pre", "__maybe", "__key", "__group", "__keep", "__size")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"), digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
