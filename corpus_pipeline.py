"""The corpus pipeline: quality, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents (COLUMNS; others are left out). ``run`` writes each stage's rows to the shared scratch folder, reads them for
the next and then deletes those of the one before. An empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftlake.llm import near_copies as near
from siftlake.llm.bpe import encode
from siftlake.llm.common import discard, materialise, read
from siftlake.llm.line_dedup import line_dedup
from siftlake.llm.mixing import in_order, mix
from siftlake.llm.quality import classify, quality_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the table's own labels, doesn't reject.

    Null counts as empty, an empty or very long text is scored like any other; repeated rows share their score and so
    stay or go together, rows of equal scores, too. Null in another column decides nothing.
    """
    return classify(docs.select(*COLUMNS), quality_model(spark, sf_dir)).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that others hold, too; n_chars follows the text.

    Null text becomes empty, and a text may be empty afterwards; such documents stay. Rows of one id are one document,
    rows without id too, which loses to every id. Very long texts are split within their row.
    """
    kept = line_dedup(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of five-word-shingle similarity 0.8 or more connect, that of the smallest id.

    SimHash near-dedup proposes the pairs, their similarity decides. Texts without words (null, too) are one group; a
    row without id stays only in a group that has no other; of repeated rows one stays. Very long texts are hashed whole.
    """
    return near.near_copies(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix reads, in training order; a document may come twice or, beyond its source's target, not at all.

    The order is that of the rows in the files that are written, which the next stage tells. Texts without words (null,
    too) have size 0 and come once or twice at their place; a null source is a source; rows without id have their place
    by their text; repeated rows are rows of their own, ties in position go by id.
    """
    return in_order(mix(docs.select(*COLUMNS))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, whether they decode to it, and its place in the training order: part, then at.

    The place is that of the row in the files ``docs`` is read from, which the mixture has sorted; of a table that isn't
    read from files it is null. Null text has no ids, a very long one is encoded whole, repeated rows are each encoded.
    """
    try:
        placed = docs.select("doc_id", "source", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        placed = docs.select("doc_id", "source", "text", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("at"))
    out = encode(placed, verify=True, keep=["doc_id", "source", "part", "at"])
    return out.select("doc_id", "source", "part", "at", "n_tokens", "token_ids", "round_trip")


STAGES = [("quality", quality), ("line dedup", lines), ("near-dedup", near_copies), ("mixing", mixture), ("bpe", tokens)]

#: SQL can't express the classifier, the fingerprints or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
