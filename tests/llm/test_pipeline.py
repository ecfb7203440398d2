"""The pipeline: each stage on its predecessor's rows, held against what it must do."""

import sys
from pathlib import Path

import tiktoken  # noqa: F401

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402
import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from siftlake.llm.common import materialise  # noqa: E402
from siftlake.llm.mixing import in_order, mix  # noqa: E402
from siftlake.llm.quality import CUT, features, quality_model  # noqa: E402
from tests.llm.test_bpe import THEIRS  # noqa: E402
from tests.llm.test_dedup import lines_by_hand  # noqa: E402
from tests.llm.test_mixing import targets_by_hand  # noqa: E402
from tests.llm.test_near_copies import connected  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "line dedup", "near-dedup", "mixing", "bpe"]
    seen = [docs.collect()]
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "test")
        seen.append(docs.collect())
        if name != "bpe":
            assert docs.columns == P.COLUMNS
    start, good, lines, single, mixed, coded = seen
    model = quality_model(spark, sf_dir)
    keep = {r["doc_id"] for r in start if model.score(features(r["text"])[None, :])[0] >= CUT}
    assert {r["doc_id"] for r in good} == keep and 0 < len(keep) < len(start)
    assert sorted((r["doc_id"], r["text"]) for r in lines) == sorted((i, t) for i, _, _, t in lines_by_hand([(r["doc_id"], r["text"]) for r in good]))
    order = sorted(lines, key=lambda r: r["doc_id"])
    root = connected([r["text"] for r in order])
    assert sorted(r["doc_id"] for r in single) == sorted(order[i]["doc_id"] for i in set(root))
    size, words = {}, {r["doc_id"]: len((r["text"] or "").encode().split()) for r in single}
    for r in single:
        size[r["source"]] = size.get(r["source"], 0) + words[r["doc_id"]]
    want, got, longest = targets_by_hand(size), {}, {}
    for r in mixed:
        got[r["source"]] = got.get(r["source"], 0) + words[r["doc_id"]]
        longest[r["source"]] = max(longest.get(r["source"], 0), words[r["doc_id"]])
    assert all(abs(got.get(s, 0) - want[s]) <= longest.get(s, 0) + 1 for s in want)
    text = {r["doc_id"]: r["text"] for r in single}
    assert len(coded) == len(mixed) and all(r["round_trip"] for r in coded)
    assert all(np.frombuffer(r["token_ids"], "<u4").tolist() == THEIRS.encode_ordinary(text[r["doc_id"]] or "") for r in coded)


def test_tokens_keep_the_training_order(spark, sf_dir):
    """part and at sort the tokens as the mix has sorted its copies, over several files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [(r["doc_id"], r["position"]) for r in in_order(mix(docs)).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = materialise(P.mixture(spark, docs, sf_dir), "test")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = P.tokens(spark, mixed, sf_dir).orderBy("part", "at").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in want] and len({r["part"] for r in got}) > 1
    assert P.tokens(spark, docs.limit(3).union(docs.limit(2)), sf_dir).where("at is null").count() == 5


def test_odd_rows(spark, sf_dir):
    """Nulls, empty and repeated texts, clashing and extra columns, and no rows at all, in every stage."""
    long = "a line that three documents hold for sure"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, f"{long}\nown", "en", "s", 1), (4, long, "en", None, 1), (5, long, None, "s", 1), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (7, "w " * 200_000, "en", "t", 9), (7, "w " * 200_000, "en", "t", 9)]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"Score": F.lit("x"), "kept": F.lit(1), "__row": F.lit(2)}), "test")
    scored = P.quality(spark, docs, sf_dir)
    assert scored.columns == P.COLUMNS and scored.count() <= len(rows)
    kept = {(r["doc_id"], r["text"]) for r in P.lines(spark, docs, sf_dir).collect()}
    assert (1, "") in kept and (3, "own") in kept and (4, "") in kept and (5, long) in kept and (None, "no id") in kept
    single = [r["doc_id"] for r in P.near_copies(spark, docs, sf_dir).collect()]
    assert sorted(map(str, single)) == ["1", "3", "7", "None"]  # 3 and 4 share four of five shingles
    mixed = P.mixture(spark, docs, sf_dir)
    assert mixed.columns == P.COLUMNS and mixed.where("doc_id = 7").count() >= 2
    assert all(r["round_trip"] for r in P.tokens(spark, docs, sf_dir).collect())
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert P.ORACLE_SQL is None and P.run(spark, sf_dir).where("round_trip").count() > 0
