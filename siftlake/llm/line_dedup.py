"""Line dedup: drop lines that many documents hold. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import BLANKS, adds, discard, flag_in_filter, materialise, read, slot_filter

#: A-Z and their lower case, for texts that lower() would change beyond those.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the bitmap of documents that lose lines: 1 MB as rows, whatever the input.
SLOTS = 1 << 22


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _twice(*columns: str) -> list[Column]:
    """128 bits of the columns, as two hashes of 64 bits with different seeds."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def _marks(positions: Column) -> Column:
    """A byte for each line up to the last of the ascending ``positions``: 1 for those, 0 for others."""
    gap = lambda p, i: p - F.when(i == 0, F.lit(-1)).otherwise(F.element_at(positions, F.greatest(i, F.lit(1)))) - 1
    return F.array_join(F.transform(positions, lambda p, i: F.concat(F.repeat(F.lit("0"), gap(p, i).cast("int")), F.lit("1"))), "").cast("binary")


@adds("n_lines", "n_dropped")
def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_points: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop the lines whose key (stripped, A-Z lower-cased) stands in ``min_docs`` documents or more.

    Such a key keeps its lines in the document of the largest id only, keys under ``min_points`` code points keep
    all. Replaces ``text`` by the kept lines and adds n_lines and n_dropped.

    Lines are exploded and hashed once, to a narrow table (row, id, position, hash). Hashes that are met ``min_docs``
    times are found by partial sums; only they have their documents counted, and only lines of frequent hashes are
    joined back, both told by bitmaps of fixed size before any shuffle. Each side of that join is a table, so adaptive
    execution splits a hash that a third of all documents hold. What comes back to a row is which of its positions
    to drop, as a byte for each line, which is read in constant time: lines never leave their row and aren't hashed
    again. Texts that lose no line skip that shuffle: a bitmap tells most of them, and where it is full all pass it.

    A row is known by 128 bits of its id and text, so that neither rows without id nor rows that repeat one are
    gathered; rows equal in both share their positions.

    Null or empty text is one empty line. Rows of one id are one document; rows without id count as one document
    too, which loses to every id. There is no tie: the largest id is one document, and a line repeated within it stays
    each time. A very long text is split within its row, in time linear in its lines. Extra columns pass through; columns
    named as the added ones are replaced. An empty table gives no rows.
    """
    row = _twice(doc_id, text)
    split = docs.select(row[0].alias("r1"), row[1].alias("r2"), F.col(doc_id).alias("id"), _lines(F.col(text)).alias("lines"))  # below the generator: once a row
    each = split.select("r1", "r2", "id", F.posexplode("lines").alias("pos", "line")).withColumn("key", _key(F.col("line"))).where(F.length("key") >= min_points)
    each = materialise(each.select("r1", "r2", "id", "pos", *(c.alias(n) for c, n in zip(_twice("key"), ("h1", "h2"), strict=True))), "lines-hashed")

    often = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    some = flag_in_filter(each, "h1", slot_filter(often, "h1", SLOTS), SLOTS, "hit").where("hit").select("h1", "h2", "id").distinct()
    counted = some.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    frequent = materialise(counted.select("h1", "h2", "keeper"), "lines-frequent")
    found = flag_in_filter(each, "h1", slot_filter(frequent, "h1", SLOTS), SLOTS, "hit").where("hit")
    losing = found.join(frequent, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("r1", "r2", "pos").distinct()
    drops = materialise(losing.groupBy("r1", "r2").agg(F.sort_array(F.collect_list("pos")).alias("gone")).select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.size("gone").cast("long").alias("__gone"), _marks(F.col("gone")).alias("__marks")), "lines-drops")
    discard(each, frequent)

    marked = flag_in_filter(docs.withColumns({"__own1": row[0], "__own2": row[1]}), "__own1", slot_filter(drops, "__r1", SLOTS), SLOTS, "__hit")
    hit = marked.where("__hit")
    hit = hit.join(drops, (hit["__own1"] == drops["__r1"]) & (hit["__own2"] == drops["__r2"]), "left")
    kept = F.filter(_lines(F.col(text)), lambda x, i: F.substring(F.col("__marks"), i + 1, F.lit(1)) != F.lit(bytearray(b"1")))
    hit = hit.withColumns({"n_lines": F.size(_lines(F.col(text))).cast("long"), "n_dropped": F.coalesce("__gone", F.lit(0).cast("long"))})
    hit = hit.withColumn(text, F.when(F.col("__gone").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n")))
    rest = marked.where("NOT __hit").withColumns({"n_lines": F.size(_lines(F.col(text))).cast("long"), "n_dropped": F.lit(0).cast("long")}).withColumn(text, F.coalesce(F.col(text), F.lit("")))
    names = [*docs.columns, "n_lines", "n_dropped"]
    return hit.select(*names).unionByName(rest.select(*names))


def op10_line_dedup(spark, sf_dir):
    kept = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.*, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
