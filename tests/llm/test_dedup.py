"""Exact dedup and line dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from siftlake.llm.common import BLANKS
from siftlake.llm.exact_dedup import OP1_SQL, exact_dedup, op1_exact_dedup
from siftlake.llm.line_dedup import LOWER, OP10_SQL, UPPER, line_dedup, op10_line_dedup
from tests.test_sources_and_plans import compare

LONG = "a line of text that many documents hold"
TEXTS = [
    (1, "same text"), (2, "same  text\n"), (3, " sametext"), (4, "SAME text"), (5, None), (6, ""), (7, " \t\r\x0b\x0c\n"), (8, "x\xa0y"), (9, "xy"), (10, "é" * 80 + "a"), (11, "é" * 80 + "b"), (12, "é" * 80 + " a"),
    (None, "same text"), (13, "p" * 200_000 + "q"), (14, "p" * 200_000 + " q"), (15, "tie a"), (16, "tiea "), (16, "tiea "), (0, "ti ea"), (None, "only null id"),
]


def bare(text):
    return "".join(c for c in text or "" if c not in BLANKS)


def test_exact_dedup(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"kept": F.lit("x"), "count": F.lit(1), "id": F.lit(2)})
    for digest, slots in ((True, 1 << 10), (False, 1 << 10), (False, 64)):
        got = exact_dedup(docs, digest=digest, slots=slots)
        assert ("text_sha256" in got.columns) == digest
        got = got.collect()
        assert len(got) == len(TEXTS)
        groups = defaultdict(list)
        for i, t in TEXTS:
            groups[bare(t)].append((-len(t or ""), i is None, i))
        for r in got:
            own = groups[bare(r["text"])]
            assert r["keep_id"] == min(own, key=lambda x: x[:2] + (x[2] or 0,))[2] and r["group_size"] == len(own)
            assert r["kept"] == (len(own) == 1 or r["doc_id"] == r["keep_id"]) and r["count"] == 1
            if digest:
                assert r["text_sha256"] == hashlib.sha256(bare(r["text"]).encode()).hexdigest()
    assert exact_dedup(docs.limit(0)).count() == 0


def test_texts_stay_out_of_shuffles(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    plan = exact_dedup(docs).select("doc_id", "keep_id")._jdf.queryExecution().optimizedPlan().toString()
    join = plan[: plan.index("Relation")] if "Relation" in plan else plan
    assert "Join LeftOuter" in join


def lines_by_hand(rows, least=20, docs=3):
    key = lambda x: x.strip(BLANKS).translate(str.maketrans(UPPER, LOWER))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup(spark):
    rows = [
        (1, f"{LONG}\nown one\n{LONG}"), (2, f"\t{LONG.upper()} \nx\n\n"), (3, f"{LONG}\n{LONG}\nlast\n"), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "short"), (9, f"two of these lines only here\r\n{LONG}\xa0"), (10, "two of these lines only here"),
        (None, LONG), (None, LONG), (11, "ÀÉ" * 12), (12, "àé" * 12), (13, "ÀÉ" * 12), (14, "\n".join([f"line number {i} of a very long text" for i in range(5000)])), (15, "line number 7 of a very long text"), (16, "Line Number 7 of a very long text"), (16, "Line Number 7 of a very long text"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("x"), "line": F.lit(1)})
    got = line_dedup(docs).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == Counter(lines_by_hand(rows)) and all(r["line"] == 1 for r in got)
    assert line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_of_rows_without_id(spark):
    """A third of the rows have no id, many are alike; names that clash in another case; columns like the working ones."""
    rows = [(i if i % 3 else None, f"{LONG}\nline {i % 7} that some documents hold\nown {i}") for i in range(120)] + [(None, LONG)] * 50 + [(7, "x\n" + LONG)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"N_Lines": F.lit("x"), "__marks": F.lit(1), "__Own1": F.lit(2)})
    got = line_dedup(docs)
    assert sorted(got.columns) == ["__Own1", "__marks", "doc_id", "n_dropped", "n_lines", "text"]
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == Counter(lines_by_hand(rows))


def test_line_dedup_is_linear(spark):
    """Three documents of 50,000 boilerplate lines each, two of which lose all."""
    text = "\n".join(f"boilerplate line number {k} of the long one" for k in range(50_000))
    got = line_dedup(spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n")).collect()
    assert {tuple(r) for r in got} == {(0, 50_000, 50_000, 0), (1, 50_000, 50_000, 0), (2, 50_000, 0, len(text))}


def test_line_dedup_is_native(spark, sf_dir):
    plan = op10_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_queries(spark, sf_dir):
    compare(spark, sf_dir, op1_exact_dedup, OP1_SQL)
    compare(spark, sf_dir, op10_line_dedup, OP10_SQL)
