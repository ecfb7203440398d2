"""Language identification by n-gram filters whose slots are bitmasks of languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import adds, by_batches, read

#: Code points that are looked at together; a longer text is cut.
CHUNK = 1 << 19
#: Odd multipliers that mix a 64-bit n-gram for each of the slots probed.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(text: str | None, size: int = CHUNK) -> Iterator[str]:
    """The lower-cased text in pieces of about ``size`` code points, each between the code points next to it or blanks."""
    text = text or ""
    low = [text[a : a + size].lower() for a in range(0, len(text), size)] or [""]
    for k, part in enumerate(low):
        yield (low[k - 1][-1:] if k else " ") + part + (low[k + 1][:1] if k + 1 < len(low) else " ")


def grams(padded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 3-grams of lower-cased texts of which each stands between its neighbours, and each one's text.

    Whatever isn't a letter counts as a blank. A 3-gram holds three code points of 21 bits; those with two blanks side by
    side or a blank in the middle are left out.
    """
    sizes = np.array([len(t) for t in padded], np.int64)
    points = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(np.uint64)
    letter = letters()[points]
    points = np.where(letter, points, np.uint64(32))
    owner = np.repeat(np.arange(len(padded)), sizes)
    good = letter[1:-1] & (letter[:-2] | letter[2:]) & (owner[:-2] == owner[2:])
    at = np.flatnonzero(good)
    return (points[at] << np.uint64(42)) | (points[at + 1] << np.uint64(21)) | points[at + 2], owner[at]


def has_letter(text: str | None) -> bool:
    return any(letters()[np.frombuffer(text[a : a + CHUNK].encode("utf-32-le"), "<u4")].any() for a in range(0, len(text), CHUNK)) if text else False


def slots(keys: np.ndarray, size: int, probe: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(MULTIPLIERS[probe])
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(MULTIPLIERS[0])) >> np.uint64(20)) % np.uint64(size)


@dataclass(frozen=True)
class Languages:
    """names[i] owns bit i mod 64 of word i div 64 of every slot; false[i] is the chance that a foreign n-gram hits all its slots."""

    names: tuple[str, ...]
    masks: np.ndarray
    false: np.ndarray
    probes: int

    def hits(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        """For each language whether it may hold each n-gram: one AND of the slots' masks for 64 languages."""
        at = [slots(keys, len(self.masks), k) for k in range(self.probes)]
        for w in range(self.masks.shape[1]):
            found = self.masks[at[0], w]
            for k in at[1:]:
                found = found & self.masks[k, w]
            for i in range(64 * w, min(64 * w + 64, len(self.names))):
                yield ((found >> np.uint64(i % 64)) & np.uint64(1)) > 0

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.names)))
        group, owners, held = [], [], 0

        def count() -> None:
            keys, of = grams(group)
            owner = np.array(owners, np.int64)[of]
            n[:] += np.bincount(owner, minlength=len(texts))
            for i, hit in enumerate(self.hits(keys)):
                hits[:, i] += np.bincount(owner[hit], minlength=len(texts))

        for k, text in enumerate(texts):
            for part in pieces(text):
                if group and held + len(part) > CHUNK:
                    count()
                    group, owners, held = [], [], 0
                group.append(part)
                owners.append(k)
                held += len(part)
        if group:
            count()
        true = np.maximum(0, (hits - n[:, None] * self.false) / (1 - self.false))
        total = true.sum(1)
        best = true.argmax(1) if self.names else np.zeros(len(texts), int)
        out = []
        for k, text in enumerate(texts):
            if not self.names or (not n[k] and not has_letter(text)):
                out.append(("und", 0.0))
            else:
                out.append((self.names[best[k]], float(true[k, best[k]] / total[k]) if total[k] else 0.0))
        return out


def _edges(rows: DataFrame, sample: int) -> dict[str, int]:
    """For each language of (lang, h) the hash up to which there are ``sample`` different ones, or the highest.

    Hashes are even, so a bound that keeps four times the sample of a language's rows holds its lowest ones, and few
    rows are ranked, however many a language has. Where ids repeat so much that it doesn't, all are ranked.
    """
    session = rows.sparkSession
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language

    def ranked(some: DataFrame) -> dict[str, tuple[int, int]]:
        order = W.partitionBy("lang").orderBy("h")
        lowest = some.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
        return {r["lang"]: (r["edge"], r["n"]) for r in lowest.groupBy("lang").agg(F.max("h").alias("edge"), F.count(F.lit(1)).alias("n")).collect()}

    if not n:
        return {}
    bounds = session.createDataFrame([(x, min((1 << 63) - 1, -(1 << 63) + (4 * sample << 64) // k)) for x, k in n.items()], "lang string, most long")
    found = ranked(rows.join(bounds, "lang").where("h <= most").select("lang", "h"))
    if short := [x for x, k in n.items() if k > 4 * sample and found.get(x, (0, 0))[1] < sample]:
        found |= ranked(rows.join(session.createDataFrame([(x,) for x in short], "lang string"), "lang", "left_semi"))
    return {x: edge for x, (edge, _) in found.items()}


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = 1500, size: int = 1 << 18, probes: int = 3, least: int = 2, ratio: float = 0.4) -> Languages:
    """Fill the filter from at most ``sample`` documents of each language, those whose ids hash lowest, whole texts each.

    A language holds an n-gram that it shows ``least`` times or more, at ``ratio`` or more of the rate of the language
    which shows it most. N-grams are counted in Spark and come to the driver as ``size`` slot masks at most, of one
    64-bit word for each 64 languages. Every language is learned, however rare. Rows without language or text teach
    nothing; rows that share the hash of an id are taken together. Languages are
    ordered by n-grams, then name, and the first of equal counts is predicted.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"))
    edges = _edges(rows.select("lang", "h"), sample)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [h <= edges[x] for x, h in zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), strict=True)]
            yield from count(batch.filter(pa.array(keep, pa.bool_())))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        said = batch.column("lang").to_pylist()
        for name in sorted(set(said)):
            found = [grams([part])[0] for k, s in enumerate(said) if s == name for part in pieces(batch.column("text")[k].as_py())]
            keys, times = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(times)], ["lang", "gram", "times"])

    counted = by_batches(rows.where(F.col("h") <= max(edges.values(), default=0)), chosen, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    names, words = tuple(totals), max(1, -(-len(totals) // 64))
    masks = np.zeros((size, words), np.uint64)
    if names:
        known = docs.sparkSession.createDataFrame([(n, float(totals[n]), i // 64, i % 64) for i, n in enumerate(names)], "lang string, of double, word int, bit int")
        rated = counted.join(known, "lang").withColumn("rate", F.col("times") / F.col("of"))
        best = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("word", "bit", "rate", "times")).alias("each"))  # one for each language at most
        held = best.select("gram", F.explode("each").alias("x"), "top").where((F.col("x.rate") >= ratio * F.col("top")) & (F.col("x.times") >= least))
        masked = held.groupBy("gram", F.col("x.word").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.bit"))).alias("mask"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.concatenate([slots(keys, size, k) for k in range(probes)]).astype(np.int64)
                repeat = lambda c: pa.array(np.tile(batch.column(c).to_numpy(zero_copy_only=False), probes))  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([pa.array(at), repeat("word"), repeat("mask")], ["slot", "word", "mask"])

        filled = by_batches(masked, place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
        masks[filled.column("slot").to_numpy(), filled.column("word").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    share = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
    return Languages(names, masks, np.minimum(share**probes, 0.99), probes)


@adds("lang_pred", "score")
def identify(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """Add lang_pred and score (that language's share of the corrected counts) from the whole text alone.

    Every n-gram's slots give, by one AND, the mask of all languages that may hold it; hits are counted per language
    and corrected for the chance of false ones. A null text or one without letters is ``und`` with score 0, as is all
    if nothing was learned. Rows are independent: ties between languages go to the more frequent one, repeated rows get
    equal results, extra columns pass through, those named as the added ones are replaced; an empty table gives no
    rows. Nothing is shuffled; a very long text is counted in pieces of CHUNK code points, of which none is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size * 8 bytes for each 64 languages, whatever the input
    keep = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                got = shared.value.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"])

    return by_batches(docs, run, T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op4_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
