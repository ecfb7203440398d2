"""Quality and language: held-out accuracy, and the defined results of odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import language as L
from siftlake.llm import quality as Q

BIG = "/root/testdata/sf0.1"


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    got = Q.op9_quality(spark, BIG).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.98
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.99


def test_quality_by_hand():
    """The gradient of the pairwise loss, written out pair by pair, vanishes; the threshold parts training scores by the share of labels."""
    draw = np.random.default_rng(0)
    rows = np.concatenate((draw.normal(0, 1, (300, 4)), draw.normal(1, 1, (700, 4))))
    labels = np.array([0] * 300 + [1] * 700)
    model = Q.fit(rows, labels, pairs=2000, ridge=0.05, seed=3)
    again = np.random.default_rng(3)
    wins, losses = again.choice(range(300, 1000), 2000), again.choice(range(300), 2000)
    centre, spread = rows.mean(0), rows.std(0) + 1e-3
    loss = lambda w: sum(np.log1p(np.exp(-((rows[a] - rows[b]) / spread) @ w)) for a, b in zip(wins, losses, strict=True)) / 2000 + 0.025 * w @ w
    step = 1e-4 * np.eye(4)
    assert all(abs(loss(model.weights + d) - loss(model.weights - d)) / 2e-4 < 1e-5 for d in step)
    assert all(loss(model.weights + 100 * d) > loss(model.weights) < loss(model.weights - 100 * d) for d in step)
    assert np.allclose(model.raw(rows), ((rows - centre) / spread) @ model.weights)
    score = model.score(rows)
    assert abs((score >= Q.CUT).sum() - 700) <= 1 and score[labels == 1].mean() > score[labels == 0].mean()
    assert Q.fit(rows, np.ones(1000)).score(rows) == pytest.approx(Q.CUT)


def plain_features(text):
    """The shares and ratios by Python's own means."""
    data = (text or "").encode()
    trigrams, hashed = [0] * Q.TRIGRAMS, [0] * Q.WORDS
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        trigrams[(((a << 16 | b << 8 | c) * 0x9E3779B1) % 2**32) >> 23] += 1
    words, lines = data.split(), data.split(b"\n")
    for w in words:
        h = (sum((x + 1) * pow(Q.BASE, i, 2**64) for i, x in enumerate(w)) + len(w)) % 2**64
        hashed[(((h * Q.SPREAD) % 2**64) >> 40) % Q.WORDS] += 1
    few, n = max(len(words), 1), max(len(data), 1)
    same = lambda x: sum(a == b for a, b in zip(x, x[1:], strict=False))
    is_sign = lambda x: 33 <= x < 48 or 58 <= x < 65 or 91 <= x < 97 or 123 <= x < 127
    upper, lower = sum(65 <= x < 91 for x in data), sum(97 <= x < 123 for x in data)
    repeated = sum(a == b and b < 65 and b not in b" \t\n\x0b\x0c\r" for a, b in zip(data, data[1:], strict=False))
    more = [len(words) / n, sum(65 <= w[0] < 91 for w in words) / few, repeated / n, upper / max(upper + lower, 1), sum(map(is_sign, data)) / n, sum(48 <= x < 58 for x in data) / n, sum(x > 127 for x in data) / n, data.count(10) / few, 1 / (1 + len(words)), same(words) / few, same(lines) / len(lines)]
    return np.sqrt([*(x / max(sum(trigrams), 1) for x in trigrams), *(x / few for x in hashed), *more])


@pytest.mark.parametrize("piece", [5, 64, 1 << 18])
def test_quality_features(monkeypatch, piece):
    """By hand, whatever the size of the pieces that a text is cut into."""
    monkeypatch.setattr(Q, "PIECE", piece)
    Q._powers.cache_clear()
    for text in [None, "", "a", "\n", "Aa  b\n1é!", "same same\nsame same\n\n\n!!  ,, 11", "x" * 300 + " " + "x" * 300, "word \x0b\x0c word\r\nword " * 9]:
        assert np.allclose(Q.features(text), plain_features(text), atol=1e-6), text
    Q._powers.cache_clear()


def test_quality_of_repeated_ids(spark):
    """Examples of large ids count however often a small id is repeated."""
    rows = [(1, f"plain words {i}") for i in range(50)] + [(2, "!!!! ####"), (3, "more plain words"), (4, "#### !!!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    model = Q.train(docs, labels, sample=4)
    got = {r["text"]: r["predicted"] for r in Q.classify(docs, model).collect()}
    assert model.weights.any() and got["more plain words"] == 1 and got["!!!! ####"] == got["#### !!!!"] == 0


def test_names_in_another_case(spark):
    docs = spark.createDataFrame([(1, "plain words", "x", 5)], "doc_id long, text string, Score string, __x int")
    got = Q.classify(docs, Q.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))).select("score", "__x", "predicted").first()
    assert 0 <= got["score"] <= 1 and got["__x"] == 5
    assert L.identify(docs, L.Languages((), np.zeros((4, 1), np.uint64), np.zeros(0), 3)).select("SCORE").first()[0] == 0


def test_quality_rows(spark):
    docs = spark.createDataFrame([(1, "plain words", "x"), (2, None, "y"), (3, "", "z"), (4, "!! " * 400_000, None), (1, "plain words", "x"), (None, "plain words", "x")], "doc_id long, text string, score string").withColumn("features", F.lit(0))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0), (3, 7)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    got = {(r["doc_id"], r["text"]): r for r in Q.classify(docs, model).collect()}
    assert len(got) == 5 and got[(1, "plain words")]["score"] == got[(None, "plain words")]["score"] and got[(2, None)]["score"] == got[(3, "")]["score"]
    assert Q.classify(docs.limit(0), model).count() == 0 and Q.train(docs.limit(0), labels).weights.sum() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang")
    got = L.op4_language(spark, BIG).join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in got if r["held_out"]]) > 0.99


def one(text):
    return L.grams(list(L.pieces(text)))[0]


def test_filter_has_no_false_negatives():
    """Masks hold every n-gram that was put in, whatever the number of languages; with exact sets the counts are those of sets."""
    draw = np.random.default_rng(0)
    texts = {f"l{i}": " ".join("".join(chr(c) for c in draw.integers(97, 123, 6)) for _ in range(30)) for i in range(70)}
    masks = np.zeros((1 << 16, 2), np.uint64)
    for i, t in enumerate(texts.values()):
        for k in range(3):
            masks[L.slots(one(t), len(masks), k), i // 64] |= np.uint64(1 << (i % 64))
    model = L.Languages(tuple(texts), masks, np.zeros(70), 3)
    assert [p[0] for p in model.predict(list(texts.values()))] == list(texts)
    sets = [set(one(t).tolist()) for t in texts.values()]
    for text in ["".join(list(texts.values())[3:5]), texts["l69"] + " zz"]:
        keys = one(text)
        counts = [hit.sum() for hit in model.hits(keys)]
        want = [sum(x in s for x in keys.tolist()) for s in sets]
        assert all(w <= c <= w + 3 for c, w in zip(counts, want, strict=True))
    assert model.predict([None, "", "12 !?", "x"])[:3] == [("und", 0.0)] * 3 and model.predict(["x"])[0][0] in texts


@pytest.mark.parametrize("size", [1, 3, 100])
def test_grams(size):
    pack = lambda s: sum(ord(c) << n for c, n in zip(s, (42, 21, 0), strict=True))
    keys, owner = L.grams([*L.pieces("Ab", 9), *L.pieces("c 1d", 9)])
    assert keys.tolist() == [pack(" ab"), pack("ab ")] and owner.tolist() == [0, 0]
    text = "The quick (brown) fox 1 two"
    assert sorted(L.grams(list(L.pieces(text, size)))[0].tolist()) == sorted(one(text).tolist())


def test_sample_of_a_language(spark):
    """The lowest hashes of each language, however many rows it has and however often an id is repeated."""
    rows = [("hot", h) for h in np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 3000).tolist()] + [("few", 5), ("few", 7), ("same", 42)] + [("same", 42)] * 500
    got = L._edges(spark.createDataFrame(rows, "lang string, h long"), 20)
    assert got == {"hot": sorted(h for x, h in rows if x == "hot")[19], "few": 7, "same": 42}
    assert L._edges(spark.createDataFrame([], "lang string, h long"), 20) == {}


def test_many_languages(spark):
    """All of 70 languages are learned, the rarest from its few documents; the model's n-grams are those of exact counting."""
    draw = np.random.default_rng(1)
    words = {i: ["".join(chr(c) for c in draw.integers(97, 123, 7)) for _ in range(12)] for i in range(70)}
    rows = [(1000 * i + k, " ".join(draw.choice(words[i], 30)), f"l{i:02}") for i in range(70) for k in range(3 if i else 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs, sample=20)
    assert set(model.names) == {f"l{i:02}" for i in range(70)} and model.masks.shape == (1 << 18, 2)
    got = L.identify(docs, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.99
    small = docs.where("doc_id >= 1000")
    model, counts = L.train(small), {}
    for _, t, lang in rows[60:]:
        for g in one(t).tolist():
            counts.setdefault(g, {}).setdefault(lang, 0)
            counts[g][lang] += 1
    totals = {x: sum(c.get(x, 0) for c in counts.values()) for x in model.names}
    masks = np.zeros_like(model.masks)
    for g, by in counts.items():
        top = max(n / totals[x] for x, n in by.items())
        for x, n in by.items():
            if n >= 2 and n / totals[x] >= 0.4 * top:
                i = model.names.index(x)
                for k in range(3):
                    masks[L.slots(np.array([g], np.uint64), len(masks), k), i // 64] |= np.uint64(1 << (i % 64))
    assert (masks == model.masks).all()


def test_language_rows(spark):
    rows = [(i, "the house and the garden " * 3, "en") for i in range(20)] + [(20 + i, "das haus und der garten " * 3, "de") for i in range(10)] + [(40, None, "en"), (41, "das haus", None), (42, "123", "de"), (43, "und " * 300_000, None), (1, "the house and the garden " * 3, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "gram": F.lit(1)})
    model = L.train(docs)
    assert set(model.names) == {"en", "de"}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs, model).collect()}
    assert got[40] == got[42] == ("und", 0.0) and got[41][0] == got[43][0] == "de" and got[1][0] == "en"
    assert L.identify(docs.limit(0), model).count() == 0
    nothing = L.train(docs.limit(0))
    assert {r["lang_pred"] for r in L.identify(docs, nothing).collect()} == {"und"}
