"""URL filters: rules first, then trust and distrust that spread over links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import adds, discard, materialise, read
from siftlake.llm.line_dedup import LOWER, UPPER

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Scores are integers, so that sums don't depend on their order: all seeds together hold UNIT.
UNIT = 10**12
#: Links to other hosts in a page.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^"'<>\s/?#]+)"""
ROUNDS, KEEP = 8, 85


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end; else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Add host, path, rule and __said, the verdict of the longest rule that fits."""
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    rule = said = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, said = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return out.withColumns({"rule": rule, "__said": said})


def _wide(value: str) -> str:
    """A 64-bit integer as one whose products with others don't overflow."""
    return f"CAST({value} AS DECIMAL(19, 0))"


def spread(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, keep: int = KEEP) -> DataFrame:
    """Scores (kind, host, score) after ``rounds`` of personalised PageRank from ``seeds`` (kind, host, score).

    ``links`` (kind, host, to, part, whole): a host passes part / whole of its score on. Each round a host gets back
    100 - ``keep`` percent of its seed and ``keep`` percent of what links bring. Contributions are summed before they
    are shuffled, both sides of each join are tables, and each round is written, so hosts of very many links are split
    and a lost executor costs one round at most.
    """
    back = seeds.select("kind", "host", F.expr(f"(score * {100 - keep}) div 100").alias("score"))
    if links.isEmpty():
        return materialise(back, "spread")
    now, before = seeds, None
    for _ in range(rounds):
        passed = now.join(links, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.expr(f"{_wide('score')} * {_wide('part')} div whole").alias("score"))
        brought = passed.groupBy("kind", "host").agg(F.sum("score").alias("score")).select("kind", "host", F.expr(f"(score * {keep}) div 100").alias("score"))
        now, before = materialise(brought.union(back).groupBy("kind", "host").agg(F.sum("score").alias("score")), "spread"), now
        if before is not seeds:
            discard(before)
    return now


@adds("host", "path", "rule", "verdict")
def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", rounds: int = ROUNDS, keep: int = KEEP, least: float = 0.1) -> DataFrame:
    """Add host, path, rule and verdict to every page.

    The longest rule that fits the url decides. Else the host does: trust spreads from hosts along their links, from
    the share of pages that rules allow, and distrust against the links, from the share that rules block, so that who
    links to blocked hosts is held against them. A host is blocked if it has more distrust than trust, and at least
    ``least`` times the mean of all hosts of pages; as much of both (a tie) is allowed. Products of scores and counts
    are decimals of 38 digits, so no number of pages or links overflows.

    Links within a host count for nothing. Null urls and such without :// have an empty host, which is judged like
    any other. Repeated rows count as pages of their own. Null and empty html has no links; a very long one is searched
    within its row, and gives a row for each of its links, summed before they are shuffled. Extra columns pass through, columns
    named as the added ones are replaced; an empty table gives no rows.
    """
    rated = judged(pages, rules, url)
    hosts = materialise(rated.groupBy("host").agg(F.count(F.when(F.col("__said") == "allow", 1)).alias("t"), F.count(F.when(F.col("__said") == "block", 1)).alias("d")), "hosts")
    whole = hosts.agg(F.greatest(F.coalesce(F.sum("t"), F.lit(0)), F.lit(1)).alias("t"), F.greatest(F.coalesce(F.sum("d"), F.lit(0)), F.lit(1)).alias("d"), F.count(F.lit(1)).alias("n")).first()
    seed = lambda kind: hosts.where(f"{kind} > 0").select(F.lit(kind).alias("kind"), "host", F.expr(f"{_wide(kind)} * {_wide(UNIT)} div {whole[kind]}L").alias("score"))
    found = rated.select("host", F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("to")).withColumn("to", F.translate("to", UPPER, LOWER)).where("host <> to")
    links = found.groupBy("host", "to").agg(F.count(F.lit(1)).alias("part"))
    both = materialise(links.select(F.lit("t").alias("kind"), "host", "to", "part").union(links.select(F.lit("d"), "to", "host", "part")), "host-links")
    sums = materialise(both.groupBy("kind", "host").agg(F.sum("part").alias("whole")), "host-sums")
    scores = spread(materialise(seed("t").union(seed("d")), "seeds"), materialise(both.join(sums, ["kind", "host"]), "host-shares"), rounds, keep)
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0))
    bad = scores.groupBy("host").agg(score("t").alias("t"), score("d").alias("d")).where((F.col("d") > F.col("t")) & F.expr(f"{_wide('d')} * {_wide(max(whole['n'], 1))} >= {int(least * UNIT)}L"))
    bad = materialise(bad.select(F.col("host").alias("__bad")), "hosts-bad")
    out = rated.join(bad, rated["host"] == bad["__bad"], "left")
    out = out.withColumn("verdict", F.coalesce("__said", F.when(F.col("__bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))))
    return out.drop("__said", "__bad")


def op6_url_filter(spark, sf_dir):
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))) + " END"
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    steps = "".join(
        f""",
r{i + 1} AS (
  SELECT kind, host, sum(score)::BIGINT AS score FROM (
    SELECT l.kind, l.too AS host, (sum((r.score * l.part) // l.whole)::BIGINT * {KEEP}) // 100 AS score
    FROM r{i} r JOIN l USING (kind, host) GROUP BY l.kind, l.too
    UNION ALL SELECT kind, host, (score * {100 - KEEP}) // 100 FROM r0) GROUP BY ALL)"""
        for i in range(ROUNDS)
    )
    return f"""
WITH u AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, html, {low.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (
  SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS said FROM h),
n AS (
  SELECT host, count(*) FILTER (WHERE said = 'allow') AS t, count(*) FILTER (WHERE said = 'block') AS d FROM p GROUP BY host),
w AS (SELECT greatest(sum(t), 1)::BIGINT AS t, greatest(sum(d), 1)::BIGINT AS d, count(*) AS hosts FROM n),
r0 AS (
  SELECT 't' AS kind, host, (n.t * {UNIT}) // w.t AS score FROM n, w WHERE n.t > 0
  UNION ALL SELECT 'd', host, (n.d * {UNIT}) // w.d FROM n, w WHERE n.d > 0),
f AS (SELECT host, {low.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS too FROM p),
g AS (SELECT host, too, count(*) AS part FROM f WHERE host <> too GROUP BY ALL),
b AS (SELECT 't' AS kind, host, too, part FROM g UNION ALL SELECT 'd', too, host, part FROM g),
l AS (SELECT *, sum(part) OVER (PARTITION BY kind, host) AS whole FROM b){steps},
x AS (
  SELECT host, coalesce(sum(score) FILTER (WHERE kind = 't'), 0) AS t, coalesce(sum(score) FILTER (WHERE kind = 'd'), 0) AS d
  FROM r{ROUNDS} GROUP BY host),
bad AS (SELECT host FROM x, w WHERE x.d > x.t AND x.d * w.hosts >= {UNIT // 10})
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""


OP6_SQL = _sql()
