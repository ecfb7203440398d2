"""WARC round trips, URL filters, and exact top-k against brute force."""

import base64
import gzip
import hashlib
import io
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.llm import topk, url_filter, warc
from tests.test_sources_and_plans import compare

PAGES = [(1, "http://a.com/x y", "<p>é</p>"), (2, "http://b.com", "same"), (5, None, "same"), (4, "u\r\nX-Bad: 1", "same"), (7, "v", None), (8, "w", ""), (9, "big", "z" * 3_000_000), (10, "crlf", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "no id", "alone"), (5, None, "same")]


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archive_round_trip():
    data = b"".join(warc.member(warc.record(i, u, (h or "").encode())) for i, u, h in PAGES)
    got = list(warc.records(io.BytesIO(data)))
    assert [(r["page_id"], r["payload"]) for r in got] == [(i, (h or "").encode()) for i, _, h in PAGES]
    assert all(r["payload_digest"] == sha(r["payload"]) and r["payload_bytes"] == len(r["payload"]) for r in got)
    assert got[0]["url"] == "http://a.com/x%20y" and got[3]["url"] == "u%0D%0AX-Bad:%201" and got[2]["url"] is None
    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1\r\nWARC-Type: response") == len(PAGES)
    revisit = list(warc.records(io.BytesIO(warc.member(warc.record(3, "u", b"abc", refers_to=9)))))[0]
    assert (revisit["record_type"], revisit["refers_to"], revisit["payload_bytes"], revisit["payload_digest"], revisit["payload"]) == ("revisit", 9, 3, sha(b"abc"), None)
    assert list(warc.records(io.BytesIO(b""))) == []


def test_broken_archives():
    good = warc.record(1, "u", b"abcdef")
    for bad in (warc.member(good)[:-9], warc.member(good[:-3]), warc.member(good + b"x"), warc.member(good.replace(b"abcdef", b"abcdeX")), warc.member(good.replace(b"WARC/1.1", b"WORC/1.1")), b"no gzip at all", warc.member(good.replace(b"Content-Length: 6", b"Content-Length: 5"))):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(bad)))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**62), st.binary(max_size=300)), max_size=6), st.integers(1, 50))
def test_any_payload_in_any_chunks(rows, chunk):
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, chunk) if n > 0 else n)

    data = b"".join(warc.member(warc.record(i, "u", p)) for i, p in rows)
    assert [(r["page_id"], r["payload"]) for r in warc.records(Slow(data))] == rows


@pytest.mark.parametrize("least", [0, 4, 5])
def test_write_and_scan(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"payload": F.lit("x"), "n": F.lit(1)})
    got = warc.scan(warc.write(pages, f"{tmp_path}/{uuid.uuid4().hex}", least=least)).collect()
    assert len(got) == len(PAGES)
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for r in got:
        page = next(p for p in PAGES if p[0] == r["page_id"])
        data = (page[2] or "").encode()
        again = len(data) >= least and r["page_id"] is not None and last[page[2] or ""] != r["page_id"]
        assert r["payload_digest"] == sha(data) and r["payload_bytes"] == len(data)
        assert (r["record_type"], r["refers_to"]) == (("revisit", last[page[2] or ""]) if again else ("response", None))
        assert r["payload"] == (None if again else data)
    assert warc.scan(warc.write(pages.limit(0), f"{tmp_path}/none")).count() == 0


def test_warc_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    last = {}
    for r in rows:
        last[r["html"] or ""] = max(last.get(r["html"] or "", -1), r["page_id"])
    want = set()
    for r in rows:
        data, stays = (r["html"] or "").encode(), last[r["html"] or ""]
        want.add((r["page_id"], len(data), sha(data), "response" if stays == r["page_id"] else "revisit", None if stays == r["page_id"] else stays))
    assert {tuple(r) for r in warc.op2_warc(spark, sf_dir).collect()} == want


def test_url_rules(spark):
    cases = [
        ("https://A.Example.com/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://x.net/de/1", "x.net", "/de/1", "net/de/", "allow"), ("ftp://m.example.net/de/8#a", "m.example.net", "/de/8", "example.net/de/8", "block"), ("http://org/es/", "org", "/es/", "org/es/", "block"), ("http://com", "com", "", None, None),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("://h?q://z/en/", "h", "", None, None), ("http://É.COM/en/", "É.com", "/en/", "com/en/", "block"), ("http://x.net#/de/", "x.net", "", None, None),
    ]
    pages = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases)], "page_id long, url string, html string").withColumns({"rule": F.lit("x"), "t": F.lit(1)})
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and got[i]["verdict"] in ((verdict,) if verdict else ("allow", "block"))
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


LINKED = [
    (1, "http://bad.org/es/1", ""), (2, "http://friend.com/fr/", '<a href="http://bad.org/x">'), (3, "http://far.com/fr/", "<a HREF = 'https://friend.com/'><a href=//BAD.org?x>"), (4, "http://good.net/de/1", '<a href="http://liked.com/">'),
    (5, "http://liked.com/fr/", None), (6, "http://alone.com/fr/", '<a href="/in">'), (7, "http://bad.org/fr/", "<a href='http://good.net'>"), (8, "http://bad.org/fr/", ""),
]


def test_url_links(spark, tmp_path):
    pages = spark.createDataFrame(LINKED, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block"}
    seeds = spark.createDataFrame([("t", "a", 1000)], "kind string, host string, score long")
    links = spark.createDataFrame([("t", "a", "b", 1, 2), ("t", "a", "c", 1, 2), ("t", "b", "a", 1, 1)], "kind string, host string, to string, part long, whole long")
    now = {"a": 1000}
    for _ in range(3):
        now = {h: (1000 * 15 // 100 if h == "a" else 0) + (now.get("b", 0) if h == "a" else now.get("a", 0) // 2) * 85 // 100 for h in "abc"}
    assert {r["host"]: r["score"] for r in url_filter.spread(seeds, links, 3).collect()} == now


def test_url_counts_beyond_64_bits(spark):
    """Ten million pages of a host, and as many links, as counts; and odd rows."""
    seeds = spark.createDataFrame([("t", "a", 10**12)], "kind string, host string, score long")
    links = spark.createDataFrame([("t", "a", "b", 10**7, 10**7 + 1)], "kind string, host string, to string, part long, whole long")
    assert {r["host"]: r["score"] for r in url_filter.spread(seeds, links, 1).collect()} == {"a": 15 * 10**10, "b": 10**12 * 10**7 // (10**7 + 1) * 85 // 100}
    t = spark.range(1).select(F.lit(10**10).cast("long").alias("t"))
    assert t.select(F.expr(f"{url_filter._wide('t')} * {url_filter._wide(url_filter.UNIT)} div {10**10}L")).first()[0] == url_filter.UNIT
    rows = [(1, "http://bad.org/es/1", '<a href="http://x.com/">' * 20_000), (1, "http://bad.org/es/1", None), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"Host": F.lit(1), "__said": F.lit(2)})
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == 3 and {r["__said"] for r in got} == {2} and [r["verdict"] for r in got if r["page_id"]] == ["block"] * 2


def test_url_query(spark, sf_dir, tmp_path):
    compare(spark, sf_dir, url_filter.op6_url_filter, url_filter.OP6_SQL)
    spark.createDataFrame(LINKED, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "p"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    theirs = {r[0]: r[4] for r in con.sql(url_filter.OP6_SQL).fetchall()}
    assert theirs == {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.read.parquet(str(tmp_path / "p"))).collect()}


def best(query, own, rows, ids, k):
    return sorted(((-sum(int(a) * int(b) for a, b in zip(query, r, strict=True)), i) for r, i in zip(rows, ids, strict=True) if i != own))[:k]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 40), st.integers(1, 12), st.integers(1, 6), st.sampled_from([1, 3, 200]))
def test_maxscore(seed, n, dims, k, spread):
    draw = np.random.default_rng(seed)
    rows, query, ids = draw.integers(-spread, spread + 1, (n, dims)).astype(float), draw.integers(-spread, spread + 1, dims).astype(float), np.arange(n) * 3
    for f in (topk.maxscore, topk._exact):
        got_ids, score = f(query, 6, rows, ids, k)
        assert sorted((-int(s), i) for s, i in zip(score, got_ids.tolist(), strict=True)) == best(query, 6, rows, ids.tolist(), k)


def test_maxscore_prunes_many_rows():
    draw = np.random.default_rng(2)
    rows = np.floor(256 * draw.normal(0, 0.1, (6000, 64)))
    ids = np.arange(6000)
    for q in (0, 17, 4001):
        got_ids, score = topk.maxscore(rows[q], q, rows, ids, 5)
        want = rows @ rows[q]
        want[q] = -np.inf
        assert got_ids.tolist() == np.lexsort((ids, -want))[:5].tolist() and score.tolist() == sorted(want, reverse=True)[:5]


def test_top_k_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, [3.0, 3.0]), (2, [3.0, 3.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [9.0]), (None, [5.0, 5.0]), (100, None), (9, [3e38, -3e38]), (10, [0.001, -0.001]), (1, [3.0, 3.0]), (50, [2.0, 2.0]), (50, [2.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "shard": F.lit(1)})
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, most=4, least=1).collect()
    fine = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] + [0] * (2 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    clip = lambda x: min(max(x, topk.LONG[0]), topk.LONG[1])
    want = []
    for at, (q, query) in enumerate(fine):
        if q % 50 == 0:  # every such row asks, and leaves out itself alone
            numbered = best(query, at, [v for _, v in fine], list(range(len(fine))), len(fine))
            want += [(q, n + 1, i, clip(-s)) for n, (s, i) in enumerate(sorted((s, fine[k][0]) for s, k in numbered)[:5])]
    assert sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in got) == sorted(want)
    others = topk.top_k(vectors.where("vec_id < 3"), queries=vectors.where("vec_id = 8"), k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in others) == [(8, 1, 1, 2304 * 768), (8, 2, 1, 2304 * 768)]
    assert topk.top_k(vectors.limit(0), F.lit(True)).count() == 0


def test_known_scores_prune_without_loss():
    draw = np.random.default_rng(5)
    rows, query = np.floor(256 * draw.normal(0, 0.1, (3000, 16))), np.floor(256 * draw.normal(0, 0.1, 16))
    score = np.sort(rows @ query)
    for known in (score[-5], score[-1], score[-1] + 1):
        got = topk.maxscore(query, -1, rows, np.arange(3000), 5, known=known)[1]
        assert sorted(s for s in got if s >= known) == [s for s in score[-5:] if s >= known]


def test_top_k_query(spark, sf_dir):
    compare(spark, sf_dir, topk.op5_topk, topk.OP5_SQL)


def test_file_names():
    from siftlake.sources.files import opened

    assert opened("/a/b")[1] == "/a/b" and opened("file:///a/b")[1] == "/a/b" and opened("file:/a/b")[1] == "/a/b" and opened("dbfs:/x/y")[1] == "/dbfs/x/y"
    with pytest.raises(ValueError):
        opened("wasb://a@b/c")


def test_scratch_needs_a_shared_folder():
    from siftlake.llm import common

    class Conf(dict):
        """Settings of a session whose warehouse is on each machine's own disk."""

    class Far:
        master, applicationId = "spark://h:7077", f"far-{uuid.uuid4().hex}"
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Far, Conf({"spark.sql.warehouse.dir": "file:/warehouse"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_folder(Session)
