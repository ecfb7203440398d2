"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import adds, by_batches, read

#: Bytes that are counted at once.
PIECE = 1 << 18
#: Buckets of hashed byte trigrams and of hashed words.
TRIGRAMS, WORDS = 512, 256
#: The score from which a document counts as good.
CUT = 0.7
#: An odd number whose powers weigh the bytes of a word, its inverse modulo 2^64, and one that spreads hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE, SPREAD = pow(BASE, -1, 1 << 64), 0xBF58476D1CE4E5B9


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, 0 to PIECE."""
    out = []
    for x in (BASE, INVERSE):
        rows = np.full(PIECE + 1, x, np.uint64)
        rows[0] = 1
        out.append(np.multiply.accumulate(rows))
    return out[0], out[1]


class _Repeats:
    """Parts of a byte stream between separators, by their hashes: how many, and how many equal the one before."""

    def __init__(self, empty: bool, buckets: int = 0):
        self.empty, self.n, self.again, self.counts = empty, 0, 0, np.zeros(buckets)
        self.last: np.uint64 | None = None
        self.open = self.length = np.uint64(0)

    def add(self, weighed: np.ndarray, cuts: np.ndarray, inverse: np.ndarray) -> None:
        """``weighed``: bytes times powers, summed up; ``cuts``: where separators stand. What is open at the end goes on in the next piece."""
        with np.errstate(over="ignore"):
            self._add(np.concatenate((np.zeros(1, np.uint64), weighed)), len(weighed), cuts, inverse)

    def _add(self, before: np.ndarray, size: int, cuts: np.ndarray, inverse: np.ndarray) -> None:
        if not len(cuts):
            self._extend(before[-1], size)
            return
        self._extend(before[cuts[0]], int(cuts[0]))
        begin, end = cuts[:-1] + 1, cuts[1:]
        hashes = (before[end] - before[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
        full = end > begin
        self._close([self.open + self.length] if self.empty or self.length else [], hashes if self.empty else hashes[full])
        self.open = self.length = np.uint64(0)
        at = int(cuts[-1]) + 1
        self._extend((before[-1] - before[at]) * inverse[at], size - at)

    def _extend(self, value: np.uint64, size: int) -> None:
        self.open = self.open + np.uint64(pow(BASE, int(self.length), 1 << 64)) * np.uint64(value)
        self.length = self.length + np.uint64(size)

    def _close(self, first: list, rest: np.ndarray) -> None:
        hashes = np.concatenate((np.array(first, np.uint64), rest))
        if not len(hashes):
            return
        self.n += len(hashes)
        self.again += int((hashes[1:] == hashes[:-1]).sum()) + int(self.last is not None and self.last == hashes[0])
        self.last = hashes[-1]
        if len(self.counts):
            self.counts += np.bincount(((hashes * np.uint64(SPREAD)) >> np.uint64(40)).astype(np.int64) % len(self.counts), minlength=len(self.counts))

    def end(self) -> None:
        if self.empty or self.length:
            with np.errstate(over="ignore"):
                self._close([self.open + self.length], np.zeros(0, np.uint64))


def features(text: str | None) -> np.ndarray:
    """Roots of shares, in the whole text, of hashed byte trigrams (TRIGRAMS buckets) and of hashed words (WORDS), then of a few ratios of words and lines, such as how many repeat the one before.

    The text is worked off in pieces of PIECE bytes; trigrams and words go on over their edges.
    """
    data = np.frombuffer((text or "").encode(), np.uint8)
    power, inverse = _powers()
    counts, grams = np.zeros(256), np.zeros(TRIGRAMS)
    words, lines = _Repeats(False, WORDS), _Repeats(True)
    begun = capital = repeated = 0
    blank = True
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE]
        counts += np.bincount(part, minlength=256)
        wide = data[max(0, a - 2) : a + PIECE].astype(np.uint32)
        if len(wide) > 2:
            packed = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
            grams += np.bincount((packed * np.uint32(0x9E3779B1)) >> np.uint32(23), minlength=TRIGRAMS)
        space = (part == 32) | ((part >= 9) & (part <= 13))
        begin = np.concatenate(([blank], space[:-1])) & ~space
        begun += int(begin.sum())
        capital += int((begin & (part >= 65) & (part <= 90)).sum())
        near = data[max(0, a - 1) : a + PIECE]
        repeated += int(((near[1:] == near[:-1]) & ((near[1:] < 9) | (near[1:] > 13)) & (near[1:] != 32) & (near[1:] < 65)).sum())
        blank = bool(space[-1])
        weighed = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], dtype=np.uint64)
        words.add(weighed, np.flatnonzero(space), inverse)
        lines.add(weighed, np.flatnonzero(part == 10), inverse)
    words.end()
    lines.end()
    n, few = max(len(data), 1), max(begun, 1)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    signs = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    more = [begun / n, capital / few, repeated / n, upper / max(upper + lower, 1), signs / n, counts[48:58].sum() / n, counts[128:].sum() / n, counts[10] / few, 1 / (1 + begun), words.again / few, lines.again / lines.n]
    return np.sqrt(np.concatenate((grams / max(grams.sum(), 1), words.counts / few, more))).astype(np.float32)


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised features, and the raw score that maps to CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        shifted = self.raw(rows) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def drawn_pairs(labels: np.ndarray, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``pairs`` drawn rows labelled 1 and as many labelled 0."""
    draw = np.random.default_rng(seed)
    return draw.choice(np.flatnonzero(labels == 1), pairs), draw.choice(np.flatnonzero(labels == 0), pairs)


def fit(rows: np.ndarray, labels: np.ndarray, pairs: int = 30_000, ridge: float = 1e-2, steps: int = 25, seed: int = 7) -> Ranking:
    """Learn weights from ``pairs`` drawn pairs of a row labelled 1 and one labelled 0, the first preferred.

    Bradley-Terry: the chance that a beats b is the logistic function of the difference of their scores. Newton
    steps, each solved by conjugate gradients, minimise the logistic loss on differences of features with a ridge; the
    differences are never laid out, since a row's scores and gradients serve all its pairs. The threshold is the
    quantile of the training scores at the share of rows labelled 0. Without both labels all weights are 0 and every
    score is CUT.
    """
    dims = rows.shape[1]
    if not (labels == 1).any() or not (labels == 0).any():
        return Ranking(np.zeros(dims), np.ones(dims), np.zeros(dims), 0.0)
    mean, scale = rows.mean(0, dtype=np.float64), rows.std(0, dtype=np.float64) + 1e-3
    x = (rows - mean) / scale
    good, bad = drawn_pairs(labels, pairs, seed)

    def gaps(v: np.ndarray) -> np.ndarray:
        score = x @ v
        return score[good] - score[bad]

    def back(r: np.ndarray) -> np.ndarray:
        return x.T @ (np.bincount(good, r, len(x)) - np.bincount(bad, r, len(x))) / pairs

    w = np.zeros(dims)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(gaps(w), -30, 30)))
        slope, weight = back(p - 1) + ridge * w, p * (1 - p)
        step, rest = np.zeros(dims), slope.copy()
        way, size = rest.copy(), rest @ rest
        for _ in range(60):
            if size < 1e-16:
                break
            curved = back(weight * gaps(way)) + ridge * way
            far = size / (way @ curved)
            step, rest = step + far * way, rest - far * curved
            size, old = rest @ rest, size
            way = rest + size / old * way
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    scores = np.sort(x @ w)
    at = int((labels == 0).sum())  # so many stay below
    threshold = (scores[at - 1] + scores[min(at, len(scores) - 1)]) / 2
    return Ranking(mean, scale, w, float(threshold))


def _featured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).tobytes() for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.binary())], [*keep, "features"])

    return by_batches(docs, run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("features", T.BinaryType())]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = 6000, **how) -> Ranking:
    """Fit on at most ``sample`` labelled documents, those whose ids hash lowest; their features go to the driver, 3 kB each.

    An id labelled more than once takes its smallest label; labels other than 0 and 1 aren't used. Rows that repeat an
    id are one example, the one whose features sort first, so the bound holds whatever the table repeats.
    """
    chosen = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.min(label).cast("int").alias("__label")).withColumnRenamed(doc_id, "__id")
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    examples = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__doc", "__label", "__text")
    one = _featured(examples, "__text", ["__doc", "__label"]).groupBy("__doc").agg(F.min("__label").alias("__label"), F.min("features").alias("features"))
    got = sorted((r["__doc"], r["__label"], bytes(r["features"])) for r in one.collect())
    rows = np.frombuffer(b"".join(g[2] for g in got), np.float32).reshape(len(got), len(features("")))
    return fit(rows, np.array([g[1] for g in got]), **how)


@adds("score", "predicted")
def classify(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """Add score (0 to 1, higher for better texts) and predicted (1 from CUT on), from the whole text alone.

    Null counts as empty, and an empty text gets the score of its features like any other. Rows are scored
    independently in the order they come, nothing is shuffled; ties and repeated rows get equal scores. A very long text
    is counted in pieces. Extra columns pass through, columns named score and predicted are replaced; an empty table
    gives no rows.
    """
    keep = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                score = model.score(np.stack([features(t.as_py()) for t in part.column(text)]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32), pa.int32())], [*keep, "score", "predicted"])

    return by_batches(docs, run, T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_model(spark, sf_dir) -> Ranking:
    """The model of the query and of the pipeline: learned from labels that aren't held out."""
    labels = read(spark, sf_dir, "labels").where(~_held_out())
    return train(read(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op9_quality(spark, sf_dir):
    scored = classify(read(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", "predicted")
