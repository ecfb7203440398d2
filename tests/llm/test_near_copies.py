"""Near-dedup by exact similarity against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm.near_copies import near_copies, shingle_set, sketch, word_fingerprints, word_hashes


def shingles(text, words=5):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def connected(texts, least=0.8):
    """Smallest index reachable by pairs that are similar enough, by brute force."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= least:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return root


def replaced(draw, words, share, vocabulary):
    out = list(words)
    for i in draw.choice(len(out), max(1, round(share * len(out))), replace=False):
        out[i] = str(draw.choice(vocabulary))
    return out


def check(rows, got):
    assert len(got) == len(rows)
    root = connected([r["text"] for r in got])
    for i, r in enumerate(got):
        assert r["component_id"] == min((x["doc_id"] for k, x in enumerate(got) if root[k] == root[i] and x["doc_id"] is not None), default=None)
    kept = [i for i, r in enumerate(got) if r["kept"]]
    assert len(kept) == len({root[i] for i in kept}) == len(set(root))
    assert all(got[i]["doc_id"] == got[i]["component_id"] for i in kept)


def test_shingles():
    for t in [None, "", " \n", "One", "a b c d", "a b c d e", "A b C a B c d é É a b c a b\x0bc", "w " * 300]:
        assert len(shingle_set(t)) == len(shingles(t)), t
    assert shingle_set("a b c d e f").tolist() == shingle_set("A  b C\td e F").tolist() != shingle_set("f e d c b a").tolist()


def test_fingerprints():
    """Bits by hand: those in over half of the words' mixed hashes; none without words."""
    words = np.unique(word_hashes("Some words, some more words; and some others. " * 3))
    got = word_fingerprints(word_hashes("some others. and WORDS; more some words, Some"), 16)
    salted = np.stack([words ^ np.uint64(s * 0x9E3779B97F4A7C15 % 2**64) for s in range(1, 13)], 1)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        salted = (salted ^ (salted >> np.uint64(31))) * np.uint64(factor)
    salted ^= salted >> np.uint64(32)
    bits = np.unpackbits(salted.view(np.uint8).reshape(len(words), -1), axis=1).sum(0) * 2 > len(words)
    assert [f"{int(x):064b}"[:48] for x in got] == ["".join("01"[int(b)] for b in bits[48 * k : 48 * k + 48]) for k in range(16)]
    assert not (got & np.uint64(0xFFFF)).any() and not word_fingerprints(word_hashes(" "), 16).any()
    assert word_fingerprints(words, 16).tolist() == got.tolist()


def test_sketches_never_differ_in_more_than_the_sets():
    draw = np.random.default_rng(2)
    for _ in range(300):
        pool = draw.integers(0, 2**64, draw.integers(2, 600), dtype=np.uint64)
        a, b = (np.unique(draw.choice(pool, draw.integers(1, len(pool) + 1))) for _ in range(2))
        assert np.bitwise_count((sketch(a) ^ sketch(b)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_order_counts(spark):
    """The same words in another order are no near copy, nor are texts that differ in too many places."""
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in draw.choice(5000, 200)]
    texts = [" ".join(words), " ".join(draw.permutation(words)), " ".join(["x", *words[1:]]), " ".join(replaced(draw, words, 0.08, ["y", "z"]))]
    assert connected(texts) == [0, 1, 0, 3]
    got = near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {0, 1, 3}


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    """Crowds, chains and pairs on both sides of 0.8; repeated, missing and empty rows."""
    draw = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size, copies, share in [(60, 40, 0.04), (150, 30, 0.03), (100, 60, 0.02), (8, 10, 0.1), *[(int(draw.integers(3, 300)), 3, 0.025)] * 10]:
        base = [str(x) for x in draw.choice(vocabulary, size)]
        texts.append(" ".join(base))
        last = base
        for k in range(copies):
            last = replaced(draw, last if k % 3 == 2 else base, draw.uniform(0, 2 * share), vocabulary)
            texts.append(" ".join(last))
    texts += ["", None, " \t", "one", "ONE", "one two", texts[0], texts[50].upper()]
    rows = [(i if i % 17 else None, t, "p", True) for i, t in enumerate(texts)] + [(5, texts[5], "p", True), (None, "alone", "p", True), (5, "other text", "p", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, kept boolean").withColumn("extra", F.lit(1))
    got = near_copies(docs)
    assert sorted(got.columns) == ["component_id", "doc_id", "extra", "kept", "text"]
    check(rows, got.collect())
    assert near_copies(docs.limit(0)).count() == 0


def test_pipeline_stage(spark, sf_dir):
    """The stage keeps what brute force keeps of the whole table: no document below 0.8 is lost."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    root = connected([r["text"] for r in rows])
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()}
    assert kept == {rows[i]["doc_id"] for i in set(root)} and len(kept) < len(rows)


def test_replaced_words(spark, sf_dir):
    """Copies with 1-4 % of the words replaced by words of the same language: none below 0.8 links, 99 of 100 others do."""
    draw, rows, pairs = np.random.default_rng(8), [], {}
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect() if len((r["text"] or "").split()) >= 60][:60]
    said = {}
    for r in docs:
        said.setdefault(r["lang"], []).extend(r["text"].split()[:200])
    for r in docs:
        for share in (0.01, 0.02, 0.03, 0.04):
            base = [f"d{len(pairs)}", *r["text"].split()]
            base = [w + str(len(pairs)) if i % 5 == 0 else w for i, w in enumerate(base)]  # no pair is near another
            a, b = " ".join(base), " ".join(replaced(draw, base, share, said[r["lang"]]))
            pairs[len(rows)] = jaccard(shingles(a), shingles(b))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[i + 1] == i for i, s in pairs.items() if s < 0.8)
    found = [got[i + 1] == i for i, s in pairs.items() if s >= 0.8]
    print("found", sum(found), "of", len(found))
    assert len(found) > 50 and np.mean(found) >= 0.99
