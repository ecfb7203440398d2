"""SimHash near-dedup against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftlake.llm.components import components
from siftlake.llm.simhash import fingerprint, forest, near_dedup, near_links, op3_simhash, walk


def plain(text, words=3):
    parts = [p for p in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if p]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(prints, budget=3):
    """Smallest index reachable, by brute force."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def crowded(n, seed):
    """Values in a few dense clouds, and some apart."""
    draw = np.random.default_rng(seed)
    centres = draw.integers(0, 2**64, 6, dtype=np.uint64)
    out = set(draw.integers(0, 2**64, n // 3, dtype=np.uint64).tolist())
    while len(out) < n:
        v = int(centres[draw.integers(6)])
        for b in draw.integers(0, 64, draw.integers(1, 6)):
            v ^= 1 << int(b)
        out.add(v)
    return np.array(sorted(out), np.uint64)


def test_fingerprint():
    for t in [None, "", " \n", "One", "One two", "a b c", "A b C a B c d", "é É ß A B c\x0bd\x1ce f", "w " * 500 + "x y z"]:
        assert fingerprint(t) == plain(t), t
        assert fingerprint(t, 5) == plain(t, 5), t


def test_long_texts_in_pieces(monkeypatch):
    from siftlake.llm import simhash

    whole = simhash.word_pieces
    text = " ".join(f"Word{i % 97}" for i in range(3000))
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(simhash, "word_pieces", lambda t, size=size: whole(t, size))
        assert fingerprint(text) == plain(text) and fingerprint("a b") == plain("a b")


@pytest.mark.parametrize("seed", range(3))
def test_walk_finds_all_pairs(seed):
    v = crowded(500, seed)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 3}
    got = [p for x, y in walk(v, v, 3, 0, True) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_walk_of_two_subtries():
    v = crowded(600, 9)
    p, q = v >> np.uint64(60), np.uint64(3)
    for other in range(16):
        a, b = v[p == q], v[p == np.uint64(other)]
        left = 3 - (3 ^ other).bit_count()
        if other == 3 or left < 0 or not len(a) or not len(b):
            continue
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= 3}
        assert {t for x, y in walk(a, b, left, 4, False) for t in zip(x.tolist(), y.tolist(), strict=True)} == want


def test_forest():
    assert forest(6, iter([(np.array([1, 4]), np.array([2, 5])), (np.array([2]), np.array([4]))])).tolist() == [0, 1, 1, 3, 1, 1]


def test_links_connect_as_brute_force(spark):
    v = crowded(1500, 4)
    want = reach([int(x) for x in v])
    df = spark.createDataFrame([(s, int(x)) for x in v.view(np.int64) for s in (0, 1)], "seed int, fingerprint long")
    both = near_links(df, 3, most=64).collect()
    assert sorted((r["u"], r["v"]) for r in both if r["seed"]) == sorted((r["u"], r["v"]) for r in both if not r["seed"])
    links = [(np.int64(r["u"]).view(np.uint64), np.int64(r["v"]).view(np.uint64)) for r in both if r["seed"]]
    assert len(links) < 40 * len(v)
    at = {int(x): i for i, x in enumerate(v)}
    x, y = (np.array([at[int(p[k])] for p in links]) for k in (0, 1))
    assert forest(len(v), iter([(x, y)])).tolist() == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (200, 201), (200, 201)], "u long, v long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}
    assert components(links.limit(0)).count() == 0


def test_edges(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base, "p"), (3, base, "p"), (9, base.upper(), None), (1, None, "p"), (2, "", "p"), (None, base, "p"), (7, "other text here", "p"), (7, "other text here", "p"), (8, base + " one more", "p"), (11, "x " * 50_000, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("id", F.lit(0)).withColumn("label", F.lit("x"))
    got = near_dedup(docs)
    assert sorted(got.columns) == ["component_id", "doc_id", "fingerprint", "id", "kept", "label", "text"]
    got = got.collect()
    assert len(got) == len(rows)
    prints = [plain(r["text"]) for r in got]
    least = reach(prints)
    for i, r in enumerate(got):
        assert int(r["fingerprint"], 16) == prints[i] and len(r["fingerprint"]) == 16
        assert r["component_id"] == min(x["doc_id"] for k, x in enumerate(got) if least[k] == least[i] and x["doc_id"] is not None)
    assert sum(r["kept"] for r in got) == len(set(least))
    assert all(r["doc_id"] == r["component_id"] for r in got if r["kept"])
    assert near_dedup(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    got = sorted(op3_simhash(spark, sf_dir).collect())
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = [plain(text[r["doc_id"]]) for r in got]
    assert [int(r["fingerprint"], 16) for r in got] == prints
    assert [r["component_id"] for r in got] == [got[i]["doc_id"] for i in reach(prints)]
