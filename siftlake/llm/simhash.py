"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import adds, by_batches, discard, materialise, read, word_pieces
from siftlake.llm.components import components

#: Shingles whose bits are counted at once, node pairs that one step of the walk expands, and values that it compares at once.
BLOCK, NODES, AREA = 1 << 14, 1 << 13, 1 << 17
#: Odd multipliers that make independent hashes of one.
STRIDE, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; each is set if over half of the hashes of all shingles, repeats included, have it set.

    The text is worked off in pieces of about a megabyte, each beginning with the last words of the one before.
    """
    digest, counts, n, carry = partial(xxhash.xxh64_digest, seed=42), np.zeros(64, np.int64), 0, []
    for fresh in word_pieces(text):
        parts = carry + fresh
        if len(parts) < words:
            carry = parts
            continue
        m = len(parts) - words + 1
        n += m
        joined = b" ".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        end = np.cumsum(sizes) - 1
        begin = (end + 1 - sizes)[:m].tolist()
        stop = end[words - 1 :].tolist()
        for a in range(0, m, BLOCK):
            hashes = b"".join(map(digest, map(joined.__getitem__, map(slice, begin[a : a + BLOCK], stop[a : a + BLOCK]))))
            counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        carry = parts[m:]
    if not n and carry:  # fewer words than a shingle has
        return int.from_bytes(digest(b" ".join(carry)), "big")
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 3, to: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint of each whole text as a signed 64-bit column to the columns ``keep`` (all); nothing is shuffled."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, words) for t in batch.column(text).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bits.view(np.int64))], [*keep, to])

    return by_batches(docs, run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(to, T.LongType())]))


def walk(a: np.ndarray, b: np.ndarray, budget: int, depth: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of values at most ``budget`` bits apart in their last 64 - depth bits.

    a and b are sorted and each agrees in its first ``depth`` bits: two subtries. Pairs of nodes are walked together,
    two bits a step, with the budget left; a pair that has none left is dropped. A node is a range of the sorted
    values. Small pairs are compared outright. Pairs of nodes wait on a stack and are expanded in blocks, so that
    memory is bounded. With ``same`` a is b, and each pair is met once.
    """
    stack = [(depth, np.array([[0, len(a), 0, len(b), budget]], np.int64))]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > NODES:
            stack += [(depth, nodes[i : i + NODES].copy()) for i in range(0, len(nodes), NODES)]
            continue
        wide, high = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
        small = (wide * high <= 64) | (depth >= 64)
        if small.any():
            leaf = nodes[small]
            areas = (wide * high)[small]
            for i in _slices(areas, AREA):
                part, area = leaf[i], areas[i]
                of = np.repeat(np.arange(len(part)), area)
                k = np.arange(int(area.sum())) - np.repeat(np.cumsum(area) - area, area)
                h = high[small][i][of]
                x, y = part[of, 0] + k // h, part[of, 2] + k % h
                rest_bits = np.uint64((1 << (64 - depth)) - 1)
                near = np.bitwise_count((a[x] ^ b[y]) & rest_bits) <= part[of, 4]
                if same:
                    near &= x < y
                if near.any():
                    yield x[near], y[near]
        rest = nodes[~small]
        if not len(rest):
            continue
        shift = np.uint64(62 - depth)
        cut_a, cut_b = ((_cuts(v, rest[:, lo], rest[:, lo + 1], shift)) for v, lo in ((a, 0), (b, 2)))
        found = []
        for p in range(4):
            for q in range(4):
                left = rest[:, 4] - (p ^ q).bit_count()
                lo, hi, low, top = cut_a[:, p], cut_a[:, p + 1], cut_b[:, q], cut_b[:, q + 1]
                ok = (left >= 0) & (hi > lo) & (top > low)
                if same:
                    ok &= lo <= low  # the mirrored pair is met elsewhere
                found.append(np.stack((lo, hi, low, top, left), 1)[ok])
        stack.append((depth + 2, np.concatenate(found)))


def _slices(areas: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows whose areas sum up to ``most``, or single larger ones."""
    run = np.cumsum(areas)
    a = 0
    while a < len(areas):
        b = max(a + 1, int(np.searchsorted(run, (run[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def _cuts(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Where the four children of each node begin, and where the last ends: a binary search in all nodes at once."""
    out = np.empty((len(lo), 5), np.int64)
    out[:, 0], out[:, 4] = lo, hi
    for digit in (1, 2, 3):
        left, right = out[:, digit - 1].copy(), hi.copy()
        while (open_ := left < right).any():
            middle = (left + right) >> 1
            below = ((values[np.minimum(middle, len(values) - 1)] >> shift) & np.uint64(3)) < digit
            left = np.where(open_ & below, middle + 1, left)
            right = np.where(open_ & ~below, middle, right)
        out[:, digit] = left
    return out


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position connected to each of n positions by ``links``; arrays are merged as they come."""
    root = np.arange(n)
    for x, y in links:
        while True:
            rx, ry = root[x], root[y]
            if (rx == ry).all():
                break
            low, top = np.minimum(rx, ry), np.maximum(rx, ry)
            np.minimum.at(root, top, low)
            while not (root == root[root]).all():
                root = root[root]
    return root


def _leaves(prints: DataFrame, most: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Cut the tries of all distinct fingerprints, one for each ``seed``, so that no leaf holds over ``most``.

    Returns the leaves (seed, depth, prefix, values) and the inner nodes' children (seed, depth, prefix, child, is_leaf);
    the root is the child of itself at depth -1. Nodes are counted with partial sums; only those over ``most`` are cut
    again, ``step`` bits deeper.
    """
    leaves, children, rest, depth, used = None, None, prints.select("seed", "fingerprint"), 0, []
    while True:
        prefix = F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned("fingerprint", 64 - depth) if depth < 64 else F.col("fingerprint")
        here = rest.withColumn("prefix", prefix)
        nodes = materialise(here.groupBy("seed", "prefix").agg(F.count(F.lit(1)).alias("n")).select("seed", "prefix", (F.col("n") <= most).alias("is_leaf")), f"trie-{depth}")
        told = here.join(nodes, ["seed", "prefix"])
        own = told.where("is_leaf").repartition("seed", "prefix").groupBy("seed", "prefix").agg(F.sort_array(F.collect_list("fingerprint")).alias("values")).select("seed", F.lit(depth).alias("depth"), "prefix", "values")
        above = F.shiftrightunsigned("prefix", step) if depth else F.lit(0).cast("long")
        below = nodes.select("seed", F.lit(depth - step if depth else -1).alias("depth"), above.alias("prefix"), F.col("prefix").alias("child"), "is_leaf")
        leaves, children = (own if leaves is None else leaves.union(own)), (below if children is None else children.union(below))
        used += [nodes, rest]
        if nodes.where(~F.col("is_leaf")).isEmpty():
            out = materialise(leaves, "trie-leaves"), materialise(children, "trie-children")
            discard(*(t for t in used if t is not prints))
            return out
        rest = materialise(told.where(~F.col("is_leaf")).select("seed", "fingerprint"), "trie-heavy")
        depth += step


def _node_pairs(children: DataFrame, budget: int, step: int) -> DataFrame:
    """Pairs of leaves (seed, a_depth, a, b_depth, b, budget left) that the walk from the root reaches.

    Both nodes of a pair go down together; a leaf waits while the other goes down. Bits are compared as far as both
    are known.
    """
    inner = lambda side: children.where("depth >= 0").select(F.col("seed").alias("of_seed"), F.col("depth").alias(f"{side}_at"), F.col("prefix").alias(f"{side}_of"), F.col("child").alias(f"{side}_child"), F.col("is_leaf").alias(f"{side}_leaf"))
    pairs = children.where("depth = -1").selectExpr("seed", "0 AS a_depth", "0L AS a", "is_leaf AS a_is_leaf", "0 AS b_depth", "0L AS b", "is_leaf AS b_is_leaf", f"{budget} AS left")
    done, depth = None, 0
    while True:
        ready = pairs.where("a_is_leaf and b_is_leaf")
        done = ready if done is None else done.union(ready)
        pairs = pairs.where("not (a_is_leaf and b_is_leaf)")
        if pairs.isEmpty():
            return done
        for side in ("a", "b"):
            kids = inner(side)
            moving = pairs.where(~F.col(f"{side}_is_leaf")).join(kids, (F.col("seed") == F.col("of_seed")) & (F.col(f"{side}_depth") == F.col(f"{side}_at")) & (F.col(side) == F.col(f"{side}_of")))
            moving = moving.select(*[{side: F.col(f"{side}_child"), f"{side}_is_leaf": F.col(f"{side}_leaf"), f"{side}_depth": F.col(f"{side}_depth") + step}.get(c, F.col(c)).alias(c) for c in pairs.columns])
            pairs = moving.union(pairs.where(F.col(f"{side}_is_leaf")))
        depth += step
        both = F.least("a_depth", "b_depth")
        # a shift by 64 bits would be none at all
        cut = lambda c: F.when(both == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col(c), F.col(f"{c}_depth") - both))  # noqa: E731,B023
        pairs = pairs.withColumn("left", budget - F.bit_count(cut("a").bitwiseXOR(cut("b"))).cast("int")).where("left >= 0")
        pairs = pairs.where((cut("a") < cut("b")) | ((F.col("a_depth") == F.col("b_depth")) & (F.col("a") == F.col("b"))))
        pairs = materialise(pairs, "trie-pairs")


def near_links(prints: DataFrame, budget: int = 3, most: int | None = None, step: int = 2) -> DataFrame:
    """Links (seed, u, v), u < v, that connect exactly the fingerprints connected by pairs ``budget`` bits apart or less.

    ``prints`` holds distinct (seed, fingerprint); only those of one seed are compared. The trie is cut into leaves of
    ``most`` values; the walk of node pairs from the root down to leaves runs as joins of small tables, and below, each
    pair of leaves is walked in one task on two sorted arrays. A pair of leaves gives the forest that connects its
    values, at most one link a value, never all pairs.

    A leaf is sent to each leaf within the budget: cut d bits deep, each value is sent 1 + d + d(d-1)/2 +
    d(d-1)(d-2)/6 times for a budget of 3. So leaves are as large as a task holds with ease, 2^18 values of 8 bytes
    (d is 6, 42 copies, for 10 million fingerprints, and 16, 697 copies, for 10 billion), and smaller only where
    there would be too few for all cores. Their size changes no link.
    """
    if most is None:
        most = max(1 << 12, min(1 << 18, prints.count() // (4 * prints.sparkSession.sparkContext.defaultParallelism)))
    if most < 16 or step not in (2, 4):
        raise ValueError("leaves hold 16 values at least; a step is 2 or 4 bits")
    leaves, children = _leaves(prints, most, step)
    pairs = _node_pairs(children, budget, step)
    side = lambda s: leaves.select("seed", F.col("depth").alias(f"{s}_depth"), F.col("prefix").alias(s), F.col("values").alias(f"{s}_values"))
    parts = max(8, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    work = pairs.select("seed", "a_depth", "a", "b_depth", "b", "left").join(side("a"), ["seed", "a_depth", "a"]).join(side("b"), ["seed", "b_depth", "b"])
    work = work.select("seed", "a_depth", "a", "b_depth", "b", "left", "a_values", "b_values").repartition(parts, "seed", "a", "b", "a_depth", "b_depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                (seed, ad, a, bd, b, left) = (column[c][k].as_py() for c in ("seed", "a_depth", "a", "b_depth", "b", "left"))
                x, y = (np.sort(column[c][k].values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in ("a_values", "b_values"))
                same = (ad, a) == (bd, b)
                if same:
                    root, all_values = forest(len(x), walk(x, x, budget, ad, True)), x
                else:
                    shift = len(x)
                    root, all_values = forest(len(x) + len(y), ((p, q + shift) for p, q in walk(x, y, left, min(ad, bd), False))), np.concatenate((x, y))
                linked = np.flatnonzero(root != np.arange(len(root)))
                u, v = all_values[root[linked]].view(np.int64), all_values[linked].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), seed, np.int32)), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["seed", "u", "v"])

    return by_batches(work, run, "seed int, u long, v long")


@adds("fingerprint", "component_id", "kept")
def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, budget: int = 3, most: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add fingerprint (16 hex digits) and component_id, the smallest id reachable by links of near fingerprints.

    The fingerprint is taken over ``words``-word shingles of the lower-cased (A-Z) whole text, repeats included; a
    shorter text is one shingle, a text without words (null, too) has fingerprint zero and is linked like any
    other. Fingerprints ``budget`` bits apart or less link. Rows are fingerprinted once, into a table of the columns
    ``keep`` (all). Distinct fingerprints are joined, whatever the number of their documents, so copies cost nothing;
    components are contracted in Spark (:func:`components`).

    Also adds kept: true for one row of each component, that of the smallest id (of repeated ones, one).

    A row without id gets the component of its fingerprint but can't name it; if no id is reachable it is null.
    Rows that repeat an id are rows of their own. Extra columns pass through; columns named as the added ones are
    replaced. Ties don't occur: equal ids and texts share their decision but for kept. A very long text is worked off in
    pieces. An empty table gives no rows.
    """
    marked = with_fingerprint(docs, text, words, "__fp", keep).withColumn("__row", F.monotonically_increasing_id())
    marked = materialise(marked, "simhash-rows")  # a written row keeps its number
    first = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__row").alias("row"))).alias("first")
    prints = marked.groupBy("__fp").agg(first).withColumnRenamed("__fp", "fingerprint")
    prints = materialise(prints.withColumn("seed", F.lit(0)), "simhash-prints")  # a stored seed stays a key of the trie's joins
    links = near_links(prints.select("seed", "fingerprint"), budget, most)
    label = components(materialise(links.select("u", "v"), "simhash-links"))
    named = prints.join(label.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "first", F.coalesce("label", "fingerprint").alias("label"))
    named = materialise(named, "simhash-named")
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    known = named.join(least, "label").select(F.col("fingerprint").alias("__print"), F.col("least.id").alias("__id"), F.col("least.row").alias("__first"))
    known = materialise(known, "simhash-known")
    discard(prints, named)
    out = marked.join(known, marked["__fp"] == known["__print"], "left")
    out = out.withColumns({"fingerprint": F.lower(F.lpad(F.hex("__fp"), 16, "0")), "component_id": F.col("__id"), "kept": F.col("__row") == F.col("__first")})
    return out.drop("__fp", "__print", "__id", "__first", "__row")


def op3_simhash(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup(docs, keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")
