"""SimHash near-dedup with an exact check: fingerprints propose groups, the similarity of word shingles decides in them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import adds, by_batches, discard, flag_in_filter, materialise, slot_filter, word_pieces
from siftlake.llm.components import components
from siftlake.llm.simhash import MIX, STRIDE, near_links

#: Counters that order shingles, rare ones first, and bits of the row filters; both fixed, whatever the input.
COUNTERS, SLOTS = 1 << 18, 1 << 22
#: Bytes of shingle sets that are compared at once, and bits of each fingerprint.
PART, BITS = 1 << 22, 48
#: 64-bit words of a sketch, which bounds how many shingles two sets can share.
SKETCH = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in MIX:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the A-Z lower-cased text, in order."""
    parts = [np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64) for words in word_pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles_of(words: np.ndarray, wide: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``wide`` word hashes; fewer words are one shingle."""
    if not len(words):
        return words
    wide = min(wide, len(words))
    out = np.zeros(len(words) - wide + 1, np.uint64)
    for i in range(wide):
        out = out * np.uint64(STRIDE) + words[i : i + len(out)]
    return np.unique(_mixed(out))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    return shingles_of(word_hashes(text), words)


def word_fingerprints(words: np.ndarray, seeds: int) -> np.ndarray:
    """``seeds`` independent fingerprints of BITS bits of a set of word hashes, in the high bits of 64; zero without words.

    A bit is set if it is in over half of the words' mixed hashes.
    """
    words = np.unique(words)
    wide = seeds * BITS // 8
    out = np.zeros((seeds, 8), np.uint8)
    if not len(words):
        return out.view(np.uint64)[:, 0]
    salts = (np.arange(1, -(-wide // 8) + 1, dtype=np.uint64) * np.uint64(STRIDE))[None, :]
    counts = np.zeros(8 * wide, np.int64)
    for a in range(0, len(words), 255):  # so many bits sum up in a byte
        rows = _mixed(words[a : a + 255, None] ^ salts)
        counts += np.add.reduce(np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1)[:, :wide], axis=1), axis=0, dtype=np.uint8)
    out[:, : BITS // 8] = np.packbits(counts * 2 > len(words)).reshape(seeds, BITS // 8)
    return out.view(">u8")[:, 0].astype(np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * SKETCH classes of shingles: whether the set has an odd number of them.

    A shingle that one set has and the other lacks flips one bit, so two sketches differ in as many bits as the sets do in
    shingles, or in fewer.
    """
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = (4, 5)) -> bool:
    """Whether the Jaccard similarity of two shingle sets is ``share`` or more."""
    top, bottom = share
    return len(np.intersect1d(a, b, assume_unique=True)) * (top + bottom) >= top * (len(a) + len(b))


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_buffer(), np.uint64) for x in column)


def _pieces(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose sets have PART bytes together, or of single larger ones."""
    sizes = sum(np.diff(np.frombuffer(batch.column(c).buffers()[1], np.int32)[batch.column(c).offset :][: batch.num_rows + 1].astype(np.int64)) for c in columns)
    a = held = 0
    for i, n in enumerate(sizes.tolist() if batch.num_rows else []):
        if i > a and held + n > PART:
            yield batch.slice(a, i - a)
            a, held = i, 0
        held += n
    if batch.num_rows > a:
        yield batch.slice(a)


def _counters(sets: DataFrame) -> np.ndarray:
    """How many sets' shingles fall to each of COUNTERS slots; COUNTERS rows come to the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s in _sets(batch.column(0)):
                np.add.at(counts, (s % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    got = by_batches(sets.select("shingles"), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of rows whose shingle sets are similar."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "of_u", "of_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, "of_u", "of_v"):
                near = [similar(a, b, share) for a, b in zip(_sets(part.column("of_u")), _sets(part.column("of_v")), strict=True)]
                yield part.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return materialise(by_batches(both, run, "u long, v long"), "near-links")


def similar_links(reps: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (u, v) whose components are exactly those of all pairs of one group that are similar.

    ``reps`` has (node, group, n, weight, prefix, s0, s1 ...: the sketch), ``sets`` (node, shingles). Similar sets share a key of their prefixes;
    a key stands for a shingle within a group. Keys with the same rows are one. First each row is compared with the
    weightiest of its key, which in a crowd of copies is the one most like the others; what this links is contracted.
    Then all pairs that share a key and are in two components yet are compared, unless the count of keys that their
    prefixes share rules them out, as beyond them a pair can share what the prefix that ends first leaves, or their sketches
    do, as they differ in more bits than similar sets can in shingles. Those tests sit in the join, so a crowd doesn't
    become a row for each pair; rows that share too few keys with any don't join.
    """
    top, bottom = share
    close = lambda a, b: (F.col(a) * bottom >= F.col(b) * top) & (F.col(b) * bottom >= F.col(a) * top)
    reps = reps.withColumn("prefix", F.transform("prefix", lambda x: F.xxhash64(F.col("group"), x)))
    postings = reps.select(F.explode("prefix").alias("key"), "node", "n", "weight")
    repeated = materialise(postings.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "near-keys")
    found = flag_in_filter(postings, "key", slot_filter(repeated, "key", SLOTS), SLOTS, "__may").where("__may").select("key", "node", "n", "weight")
    held = materialise(found.join(repeated, "key", "left_semi"), "near-postings")
    crowds = held.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.max(F.struct("weight", "n", "node")).alias("lead"))
    crowds = crowds.groupBy("c", "x", "y").agg(F.min(F.struct("key", "lead")).alias("one")).select(F.col("one.key").alias("key"), "c", F.col("one.lead.node").alias("lead"), F.col("one.lead.n").alias("lead_n"))
    members = materialise(held.select("key", "node", "n").join(materialise(crowds, "near-crowds"), "key"), "near-members")

    pairs = members.where((F.col("node") != F.col("lead")) & close("n", "lead_n")).select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v")).distinct()
    pairs = materialise(pairs, "near-pairs")
    links = _verified(pairs, sets, share)
    label = components(links)

    rest = members.where("c > 2").join(label, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("comp"))
    rest = materialise(rest, "near-rest")
    split = rest.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("a <> b").select("key", "lo", "hi")
    rest = materialise(rest.join(split, "key"), "near-split")
    several = materialise(rest.select("node").distinct(), "near-several")
    traits = [f"s{i}" for i in range(SKETCH)]
    prefixes = reps.join(several, "node").select("node", "prefix", *traits)
    lo, hi = F.greatest("lo", F.col("n") * top / bottom), F.least("hi", F.col("n") * bottom / top)
    can = lambda e: F.size("prefix") + F.greatest(F.col("n"), e) * top / bottom + 0.001 >= (F.col("n") + e) * top / (top + bottom)
    rest = materialise(rest.join(prefixes, "node").where(can(lo) | can(hi)).select("key", "node", "n", "comp", "prefix", *traits), "near-crossing")
    side = lambda s: rest.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "comp", "prefix", *traits)))
    differ = reduce(add, (F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in traits))
    both = F.col("n_a") + F.col("n_b")
    alike = differ <= both - 2 * F.ceil(both * top / (top + bottom) - 0.001)
    beyond = F.greatest(*(F.ceil(F.col(n) * top / bottom) - 1 for n in ("n_a", "n_b")))
    likely = (F.size(F.array_intersect("prefix_a", "prefix_b")) + beyond) * (top + bottom) >= (F.col("n_a") + F.col("n_b")) * top
    more = side("a").join(side("b"), "key").where((F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & close("n_a", "n_b") & alike & likely)
    more = materialise(more.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti"), "near-pairs")
    out = links.union(_verified(more, sets, share))
    discard(repeated, held, members, pairs, rest, several, more)
    return out


def proposed_groups(classes: DataFrame, seeds: int, budget: int, most: int | None) -> DataFrame:
    """(node, group) of the classes (node, fps) that a chain of near fingerprints connects to others.

    The tries of all seeds are walked together. Classes that share a fingerprint, and those of linked ones, are connected
    through their first row. Of two classes with one fingerprint both are known by the group's least and greatest
    node; only where there are more, the fingerprints are joined back.
    """
    each = classes.select("node", F.posexplode("fps").alias("seed", "fingerprint"))
    prints = materialise(each.groupBy("seed", "fingerprint").agg(F.min("node").alias("rep"), F.max("node").alias("last"), F.count(F.lit(1)).alias("c")), "near-prints")
    key = F.xxhash64("seed", "fingerprint")
    crowded = prints.where("c > 2").select("seed", "fingerprint", "rep")
    found = slot_filter(crowded.select(key.alias("k")), "k", SLOTS)
    again = flag_in_filter(each.withColumn("__k", key), "__k", found, SLOTS, "__may").where("__may").select("seed", "fingerprint", "node")
    shared = again.join(crowded, ["seed", "fingerprint"]).where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    shared = shared.union(prints.where("c = 2").select("rep", "last"))
    links = materialise(near_links(prints.select("seed", "fingerprint"), budget, most), "near-walked")
    at = lambda c: prints.select("seed", F.col("fingerprint").alias(c), F.col("rep").alias(f"rep_{c}"))
    linked = links.join(at("u"), ["seed", "u"]).join(at("v"), ["seed", "v"]).select(F.least("rep_u", "rep_v").alias("u"), F.greatest("rep_u", "rep_v").alias("v"))
    edges = materialise(shared.union(linked).distinct(), "near-edges")
    discard(prints, links)
    return components(edges).withColumnRenamed("label", "group")


@adds("component_id", "kept")
def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, share: tuple[int, int] = (4, 5), seeds: int = 24, budget: int = 2, most: int | None = None) -> DataFrame:
    """Add component_id and kept, where documents link if the Jaccard similarity of their shingle sets is ``share`` (a fraction) or more.

    Shingles are ``words`` words of the A-Z lower-cased text in their order; a shorter text is one shingle. Candidates
    come from SimHash near-dedup: ``seeds`` fingerprints of the set of words, of 48 bits each, are linked where they
    differ in ``budget`` bits or less by the binary trie self-join, and what they connect is a group. A word that is
    replaced spoils five shingles but moves a fingerprint of words little: at a similarity of 0.8 two of 48 bits
    or less differ with a chance of 0.4, of 0.13 in texts of some sixty words, so that one of 24 nearly always does
    (README: measured recall). Within
    groups the exact similarity decides, by :func:`similar_links`: no pair of a group is missed and none below the
    share links, but for equal 64-bit hashes of unequal shingles. Components are those of the links: component_id is the
    smallest id of one, kept is true for one row of each, that of the smallest id.

    Documents with equal sets are one class, known by a 128-bit hash. A set's prefix are its first n - ceil(share n) + 1
    shingles in one global order, by the counter of their slot, so that what many share comes last. Texts pass a
    shuffle only where their class is in a group. Work grows with the square of a crowd only where its rows share
    prefix keys and yet aren't similar to what the others are.

    Texts without words (null, too) are one group. Rows without id are kept only where no row of their component has
    one, and its component_id is null then. Rows that repeat an id are rows of their own, as are repeated rows; of a tie
    in the smallest id one row is kept. A very long text is hashed in pieces, its set is held whole. Extra columns pass
    through; columns named as the added ones are replaced. An empty table gives no rows.
    """
    columns = docs.columns
    top, bottom = share

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, prints = [], []
            for t in batch.column(text):
                hashes = word_hashes(t.as_py())
                sets.append(xxhash.xxh3_128_digest(shingles_of(hashes, words).tobytes()))
                prints.append(word_fingerprints(hashes, seeds).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sets, pa.binary()), pa.array(prints, pa.list_(pa.int64()))], [*columns, "__set", "__fps"])

    schema = T.StructType([*docs.schema, T.StructField("__set", T.BinaryType()), T.StructField("__fps", T.ArrayType(T.LongType()))])
    marked = materialise(by_batches(docs, mark, schema).withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    first = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__row").alias("row"))).alias("first")
    classes = marked.groupBy("__set").agg(first, F.count(F.lit(1)).alias("rows"), F.first("__fps").alias("fps"))
    classes = materialise(classes.select("__set", "first", "rows", "fps", F.col("first.row").alias("node")), "near-classes")
    groups = materialise(proposed_groups(classes.select("node", "fps"), seeds, budget, most), "near-groups")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).tobytes() for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("group"), pa.array(sets, pa.binary())], ["node", "group", "shingles"])

    flagged = flag_in_filter(marked.select("__row", text), "__row", slot_filter(groups, "node", SLOTS), SLOTS, "__may").where("__may")
    asked = flagged.join(groups, flagged["__row"] == groups["node"]).select("node", "group", text)
    sets = materialise(by_batches(asked, shingles, "node long, group long, shingles binary"), "near-sets")
    counters = docs.sparkSession.sparkContext.broadcast(_counters(sets))  # COUNTERS * 8 bytes

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights, out, traits = [], [], [], []
            for found in _sets(batch.column("shingles")):
                seen = counters.value[(found % np.uint64(COUNTERS)).astype(np.int64)]
                n = len(found)
                sizes.append(n)
                weights.append(int(seen.sum()) // max(1, n))
                out.append(found[np.lexsort((found, seen))][: n + (-n * top // bottom) + 1].view(np.int64))
                traits.append(sketch(found))
            columns_of = np.stack(traits).T if traits else np.zeros((SKETCH, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("group"), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64()), pa.array(out, pa.list_(pa.int64())), *map(pa.array, columns_of)], ["node", "group", "n", "weight", "prefix", *names])

    names = [f"s{i}" for i in range(SKETCH)]
    reps = materialise(by_batches(sets, prefixes, "node long, group long, n long, weight long, prefix array<long>, " + ", ".join(f"{c} long" for c in names)), "near-prefixes")
    label = components(similar_links(reps, sets, share))

    named = materialise(classes.drop("fps").join(label, "node", "left").select("__set", "first", "rows", F.col("label").isNotNull().alias("linked"), F.coalesce("label", "node").alias("label")), "near-named")
    discard(classes, groups, sets, reps)
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    known = named.where("linked or rows > 1").join(least, "label").select(F.col("__set").alias("__known"), F.col("least.id").alias("__id"), F.col("least.row").alias("__first"))
    known = materialise(known, "near-known")
    discard(named)
    flagged = flag_in_filter(marked.drop("__fps"), "__set", slot_filter(known, "__known", SLOTS).select("__word_no", "__bits"), SLOTS, "__may")
    alone = flagged.where("not __may").withColumns({"component_id": F.col(doc_id), "kept": F.lit(True)}).select(*columns, "component_id", "kept")
    told = flagged.where("__may").join(known, F.col("__set") == F.col("__known"), "left")
    told = told.withColumns({"component_id": F.when(F.col("__known").isNull(), F.col(doc_id)).otherwise(F.col("__id")), "kept": F.col("__known").isNull() | (F.col("__row") == F.col("__first"))})
    return alone.union(told.select(*columns, "component_id", "kept"))
