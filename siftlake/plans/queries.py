"""The registered queries over the driver's tables, each with SQL that states what it means, not how it is found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import filters as B
from siftlake.functions import shape as shapes
from siftlake.functions.hashing import md5_bits, md5_item_bits, murmur_bits
from siftlake.functions.options import ChunkOptions
from siftlake.functions.shape import Shape
from siftlake.operators import chunks as C
from siftlake.operators import flow, maintain, slots
from siftlake.operators import slices as S
from siftlake.operators.items import chunks_of_items, merged, with_filter, words
from siftlake.plans.catalog import ChunkIndex, SliceIndex
from siftlake.plans.workspace import workspace
from siftlake.sources import dumps, filter_source, geonames
from siftlake.streaming.maintain import StreamedIndex

SHAPE = Shape(128, 4)
WIDE = Shape(8192, 4)
KEY = ["p_partkey"]
TARGET = ("ring", "Brand#2")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_items():
    return F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_filter(table(spark, sf_dir, "part"), part_items(), SHAPE)


def kept(df: DataFrame, label: str) -> DataFrame:
    """The same rows, stored: what several jobs read is made once."""
    folder = workspace(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by their keys: a file of a few MB is one split, and filters of all its rows would be made by one task."""
    return table(spark, sf_dir, "part").repartition(*KEY)


def stored_parts(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """A base table (key, filter), for indexes that are built from it and scans beside them."""
    return kept(with_filter(spread(spark, sf_dir), part_items(), SHAPE).select(*KEY, "filter"), label)


def kept_index(index: DataFrame, label: str) -> DataFrame:
    """A chunk index stored by position, for searches that read a position at a time."""
    folder = workspace(index.sparkSession, label)
    index.write.partitionBy("position").parquet(folder)
    return index.sparkSession.read.schema(index.schema).parquet(folder).select(*index.columns)


def target(*items: str, shape: Shape = SHAPE) -> bytes:
    return B.bytes_of_bits(md5_item_bits(items, shape), shape)


def keyed(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n).cast("long").alias(n) for n in names])


def keyed_bits(df: DataFrame) -> DataFrame:
    return df.withColumn("bit", F.col("bit").cast("long"))


def _bits(items: str, name: str = "bits", shape: Shape = SHAPE) -> str:
    """CTEs ``name``(k, bit) of the relation ``items``(k, item)."""
    return f"""{name} AS (
  SELECT DISTINCT k, (h1 % {shape.m} + i * (h2 % {shape.m})) % {shape.m} AS bit
  FROM (SELECT k, ('0x' || substr(md5(item), 1, 15))::BIGINT AS h1, ('0x' || substr(md5(item), 16, 15))::BIGINT AS h2
        FROM {items} WHERE item <> ''), range({shape.k}) r(i))"""


ITEMS = "items AS (SELECT p_partkey AS k, unnest(list_concat(string_split(p_name, ' '), [p_brand, p_type])) AS item FROM part)"
PART = f"{ITEMS}, {_bits('items')}"


def _wanted(*items: str) -> str:
    rows = ", ".join(f"(0, '{x}')" for x in items)
    return f"titems AS (SELECT * FROM (VALUES {rows}) v(k, item)), {_bits('titems', 'tbits')}"


WANTED = _wanted(*TARGET)
HITS = "hits AS (SELECT k AS p_partkey FROM bits WHERE bit IN (SELECT bit FROM tbits) GROUP BY k HAVING count(*) = (SELECT count(*) FROM tbits))"
SEARCH = f"WITH {PART}, {WANTED}, {HITS}"


def _hex(source: str, words: int = 2, key: str = "k") -> str:
    """A relation (key, hex) from ``source``(key, bit)."""
    return f"""(SELECT {key}, string_agg(printf('%02X', code), '' ORDER BY o) AS hex FROM (
      SELECT s.{key}, o, coalesce((SELECT bit_or(1 << (b.bit % 8)::INT) FROM {source} b WHERE b.{key} = s.{key} AND b.bit // 8 = (o // 8) * 8 + 7 - o % 8), 0) AS code
      FROM (SELECT DISTINCT {key} FROM {source}) s, range({words * 8}) r(o)) GROUP BY {key})"""


CHUNKS = "chunks AS (SELECT k AS p_partkey, (bit // 8)::BIGINT AS position, bit_or(1 << (bit % 8)::INT)::BIGINT AS code FROM bits GROUP BY ALL)"


@query("""
WITH np AS (SELECT * FROM (VALUES (10, 2000000), (12, 1000), (10, 10), (100, 100), (1000, 1000000)) v(n, one_in)),
s AS (SELECT n, one_in, ceil(n * ln(1.0 / one_in) / ln(1 / pow(2, ln(2))))::BIGINT AS m FROM np),
t AS (SELECT *, floor(ln(2) * m / n + 0.5)::BIGINT AS k FROM s),
e AS (SELECT *, m - m * pow((m - 1.0) / m, k * n) AS bits FROM t)
SELECT n::BIGINT AS n, one_in::BIGINT AS one_in, m, k, round(bits, 4) AS expected_bits, round(least(bits, m / 8.0), 4) AS entries_per_row FROM e""")
def bf_shape_catalog(spark, sf_dir):
    rows = spark.createDataFrame([(10, 2_000_000), (12, 1000), (10, 10), (100, 100), (1000, 1_000_000)], "n long, one_in long")
    m, k = shapes.from_np(F.col("n"), F.lit(1.0) / F.col("one_in"))
    out = rows.withColumns({"m": m}).withColumn("k", shapes.from_np(F.col("n"), F.lit(1.0) / F.col("one_in"))[1])
    bits, entries = shapes.entries_per_row(F.col("m"), F.col("n"), F.col("k"))
    return out.select("n", "one_in", "m", "k", F.round(bits, 4).alias("expected_bits"), F.round(entries, 4).alias("entries_per_row"))


@query(f"""
WITH items AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS item FROM part), keyed AS (SELECT item AS k, item FROM items), {_bits('keyed')}
SELECT k AS item, bit FROM bits""")
def bf_item_bits(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("item")).distinct()
    return names.select("item", F.explode(md5_bits(F.array("item"), SHAPE)).alias("bit"))


@query(f"WITH {PART} SELECT k AS p_partkey, '0x' || hex AS filter FROM {_hex('bits')}")
def bf_build_part(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", B.hex_string(F.col("filter")).alias("filter"))


@query(f"WITH {PART} SELECT k AS p_partkey, count(*) AS cardinality FROM bits GROUP BY k")
def bf_cardinality(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", B.cardinality(F.col("filter")).alias("cardinality"))


@query("""
SELECT * FROM (VALUES ('Xixerella', '80002020000A000000800020000A0000008000200008020080802000080002000000200008000200'),
 ('AD', '00410000041000000000410000041000104000010000041000104000010400000000104000010400'),
 ('US', '00000000000000000000000000000000000000015554000000000000000000000000000000000000'),
 ('Las Vegas,US', '00004010100000044000001004000100100004055555004004040100000040400000004040100000')) v(items, filter)""")
def bf_murmur_golden(spark, sf_dir):
    rows = spark.createDataFrame([("Xixerella",), ("AD",), ("US",), ("Las Vegas,US",)], "items string")
    bits = murmur_bits(F.split("items", ","), Shape(302, 21))
    return rows.withColumn("bits", bits).select("items", F.hex(B.filter_of_bits(F.col("bits"), Shape(302, 21))).alias("filter"))


@query(f"{SEARCH} SELECT p_partkey, p_partkey IN (SELECT p_partkey FROM hits) AS hit FROM part")
def bf_contains_scan(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", B.bf_contains_words(F.col("filter"), target(*TARGET)).alias("hit"))


@query("""
SELECT * FROM (VALUES (0, true), (1, false), (2, true), (3, true), (4, false), (5, false), (6, true), (7, true), (8, false)) v(case_no, hit)""")
def bf_contains_nulls(spark, sf_dir):
    cases = [(None, None), (None, b"\x01"), (b"\x01", None), (b"\x03", b"\x01"), (b"\x01", b"\x03"), (b"\x01", b"\x01\x00"), (b"\x01\xff", b"\x01"), (b"\x01", b""), (b"", b"\x00")]
    rows = spark.createDataFrame([(i, *(x and bytearray(x) if x is not None else None for x in c)) for i, c in enumerate(cases)], "case_no int, c binary, t binary")
    rows = rows.withColumns({"c": F.when(F.col("case_no") == 8, F.lit(bytearray())).otherwise(F.col("c")), "t": F.when(F.col("case_no") == 7, F.lit(bytearray())).otherwise(F.col("t"))})
    return rows.select("case_no", B.bf_contains(F.col("c"), F.col("t")).alias("hit"))


@query(f"{SEARCH} SELECT p_partkey FROM hits")
def bf_contains_sql(spark, sf_dir):
    B.register(spark)
    parts(spark, sf_dir).createOrReplaceTempView("siftlake_parts")
    return spark.sql(f"SELECT p_partkey FROM siftlake_parts WHERE bf_contains(filter, X'{target(*TARGET).hex()}')")


@query(f"WITH {PART}, b AS (SELECT p_brand AS k, bit FROM bits JOIN part ON p_partkey = k GROUP BY ALL) SELECT k AS p_brand, hex AS filter FROM {_hex('b')}")
def bf_merge_by_brand(spark, sf_dir):
    return merged(parts(spark, sf_dir), ["p_brand"]).select("p_brand", F.hex("filter").alias("filter"))


@query(f"WITH {PART} SELECT k AS p_partkey, bit FROM bits")
def bf_decode_hex(spark, sf_dir):
    back = parts(spark, sf_dir).select("p_partkey", B.from_hex(B.hex_string(F.col("filter"))).alias("f"))
    return back.select("p_partkey", F.explode(B.bits_of(B.encode_words(B.decode_words(F.col("f"))))).alias("bit"))


@query(f"WITH {PART}, {CHUNKS} SELECT * FROM chunks")
def chunk_decompose(spark, sf_dir):
    return keyed(C.chunks(parts(spark, sf_dir), KEY), "p_partkey", "position", "code")


@query("SELECT a::BIGINT AS code, b::BIGINT AS superset FROM range(1, 256) x(a), range(1, 256) y(b) WHERE (a & b) = a")
def chunk_superset_codes(spark, sf_dir):
    rows = spark.createDataFrame([(c, C.superset_codes(c)) for c in range(256)], "code long, s array<long>")
    return rows.select("code", F.explode("s").alias("superset"))


@query("SELECT a::BIGINT AS code, count(*) FILTER (WHERE b > 0 AND (a & b) = b) AS selectivity FROM range(256) x(a), range(256) y(b) GROUP BY a")
def chunk_selectivity(spark, sf_dir):
    return spark.range(256).select(F.col("id").alias("code"), C.selectivity(F.col("id").cast("int")).cast("long").alias("selectivity"))


@query(f"""
WITH {WANTED}, c AS (SELECT bit // 8 AS position, bit_or(1 << (bit % 8)::INT)::BIGINT AS code FROM tbits GROUP BY ALL)
SELECT position, code, pow(2, bit_count(code))::BIGINT - 1 AS selectivity, row_number() OVER (ORDER BY bit_count(code) DESC, position) AS rank,
       'IndexKey[' || position || ', 0x' || lower(printf('%02x', code)) || ']' AS key FROM c""")
def chunk_query_order(spark, sf_dir):
    keys = C.ordered(spark.createDataFrame(C.target_chunks(target(*TARGET)), "position int, code int"))
    return keyed(keys, "position", "code", "selectivity", "rank").withColumn("key", C.key_text(F.col("position"), F.col("code")))


@query(f"{SEARCH} SELECT p_partkey FROM hits")
def chunk_search(spark, sf_dir):
    return C.search(C.chunks(parts(spark, sf_dir), KEY), KEY, target(*TARGET))


@query(f"""
WITH {PART}, titems AS (SELECT DISTINCT p_brand AS k, p_brand AS item FROM part), {_bits('titems', 'tbits')},
n AS (SELECT k, count(*) AS n FROM tbits GROUP BY k)
SELECT t.k AS query_id, b.k AS p_partkey FROM tbits t JOIN bits b USING (bit) JOIN n ON n.k = t.k GROUP BY ALL HAVING count(*) = any_value(n.n)""")
def chunk_search_multi(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id")).distinct()
    targets = with_filter(brands, F.array("query_id"), SHAPE, to="target")
    return C.search_many(C.chunks(parts(spark, sf_dir), KEY), KEY, targets)


@query("SELECT p_partkey FROM part WHERE false")
def chunk_search_zero_target(spark, sf_dir):
    return C.search(C.chunks(parts(spark, sf_dir), KEY), KEY, bytes(16))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE list_contains(string_split(p_name, ' '), 'ring') AND p_brand = 'Brand#2'")
def chunk_search_verified(spark, sf_dir):
    base = parts(spark, sf_dir)
    exact = F.array_contains(F.split("p_name", " "), "ring") & (F.col("p_brand") == "Brand#2")
    return C.search_verified(base, C.chunks(base, KEY), KEY, target(*TARGET), exact).select("p_partkey", "p_name", "p_brand")


@query(f"WITH {PART}, {_wanted('ring')}, {HITS} SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_partkey IN (SELECT p_partkey FROM hits) AND p_size > 25")
def chunk_search_residual(spark, sf_dir):
    base = parts(spark, sf_dir)
    return keyed(C.fetch(base, C.search(C.chunks(base, KEY), KEY, target("ring")), KEY, F.col("p_size") > 25), "p_partkey", "p_size")


@query(f"""
WITH items AS (SELECT o_orderkey AS k, unnest([o_orderstatus, o_orderpriority]) AS item FROM orders), {_bits('items')}, {_wanted('O', '1-URGENT')},
h AS (SELECT k FROM bits WHERE bit IN (SELECT bit FROM tbits) GROUP BY k HAVING count(*) = (SELECT count(*) FROM tbits))
SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT k FROM h)""")
def search_fetch_rows(spark, sf_dir):
    orders = with_filter(table(spark, sf_dir, "orders"), F.array("o_orderstatus", "o_orderpriority"), SHAPE)
    key = ["o_orderkey"]
    rows = maintain.unique_rows(C.fetch(orders, C.search(C.chunks(orders, key), key, target("O", "1-URGENT")), key), key)
    return rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name")


def _numbered(spark, sf_dir):
    return S.ranked(parts(spark, sf_dir), "p_partkey")


IDS = "ids AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part)"


@query(f"""
WITH {PART}, {IDS}
SELECT idx // 64 AS block, bit, sum(CASE WHEN idx % 64 < 32 THEN 1::BIGINT << (idx % 64)::INT ELSE 0 END)::BIGINT AS low,
       sum(CASE WHEN idx % 64 >= 32 THEN 1::BIGINT << (idx % 64 - 32)::INT ELSE 0 END)::BIGINT AS high
FROM bits JOIN ids USING (k) GROUP BY ALL""")
def slice_build(spark, sf_dir):
    low = F.lit(0xFFFFFFFF)
    return S.slices(_numbered(spark, sf_dir)).select("block", "bit", F.col("word").bitwiseAND(low).alias("low"), F.shiftrightunsigned("word", 32).alias("high"))


@query(f"{SEARCH} SELECT p_partkey FROM hits")
def slice_search(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    return S.resolve(S.search(S.slices(rows), S.busy(rows), target(*TARGET), SHAPE), rows, KEY)


@query("SELECT p_partkey FROM part")
def slice_search_zero_target(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    return S.resolve(S.search(S.slices(rows), S.busy(rows), b"", SHAPE), rows, KEY)


@query(f"WITH {PART}, {IDS} SELECT idx, bit FROM bits JOIN ids USING (k)")
def slice_roundtrip(spark, sf_dir):
    return S.filters_back(S.slices(_numbered(spark, sf_dir)))


LIVE = """ids AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders),
live AS (SELECT * FROM ids WHERE o_orderkey % 7 <> 0), top AS (SELECT (max(idx) // 64 + 1) * 64 AS top FROM live)"""


def _live(spark, sf_dir):
    return S.ranked(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").where("o_orderkey % 7 <> 0")


@query(f"""
WITH {LIVE}, free AS (SELECT i AS idx, row_number() OVER (ORDER BY i) AS n FROM range((SELECT top FROM top)) r(i) WHERE i NOT IN (SELECT idx FROM live)),
new AS (SELECT o_orderkey + 10000000 AS k, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 5 = 0)
SELECT k AS new_key, coalesce(free.idx, (SELECT top FROM top) + new.n - 1 - (SELECT count(*) FROM free))::BIGINT AS idx FROM new LEFT JOIN free USING (n)""")
def busy_alloc_reuse(spark, sf_dir):
    new = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + 10_000_000).alias("new_key"))
    return keyed(S.allocate(_live(spark, sf_dir).select("idx"), new, "new_key"), "new_key", "idx")


@query(f"WITH {LIVE} SELECT count(*) AS live, any_value(top)::BIGINT AS capacity FROM live, top")
def busy_cardinality(spark, sf_dir):
    return S.cardinality(S.busy(_live(spark, sf_dir)))


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS bit FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT c_custkey AS bit FROM customer WHERE c_acctbal < 0)
SELECT 'or' AS op, bit FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL
SELECT 'and', bit FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
SELECT 'xor', bit FROM ((SELECT * FROM a UNION SELECT * FROM b) EXCEPT (SELECT * FROM a INTERSECT SELECT * FROM b))""")
def bitmap_algebra(spark, sf_dir):
    """Customers as bits of two bitmaps, in rows of 64 words each, so that they may be of any width."""
    each = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit(0).alias("side"), F.col("o_custkey").alias("bit"))
    each = each.union(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit(1), "c_custkey"))
    words = each.groupBy("side", (F.col("bit") / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("word"))
    zero = lambda side: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at(F.col(side), i), F.lit(0).cast("long")))
    held = lambda side: F.map_from_entries(F.collect_list(F.when(F.col("side") == side, F.struct((F.col("w") % 64).cast("int"), "word"))))
    blocks = words.groupBy((F.col("w") / 64).cast("long").alias("block")).agg(held(0).alias("a"), held(1).alias("b")).select("block", zero("a").alias("a"), zero("b").alias("b"))
    ops = {"or": B.word_or, "and": B.word_and, "xor": B.word_xor}
    rows = blocks.select("block", F.explode(F.array(*[F.struct(F.lit(n).alias("op"), f(F.col("a"), F.col("b")).alias("w")) for n, f in ops.items()])).alias("r"))
    return rows.select("r.op", "block", F.explode(B.set_bits(F.col("r.w"))).alias("bit")).select("op", (F.col("block") * 4096 + F.col("bit")).alias("bit"))


CHANGED = """olds AS (SELECT p_partkey AS k, unnest(list_concat(string_split(p_name, ' '), [p_brand, p_type])) AS item FROM part),
news AS (SELECT p_partkey AS k, unnest(list_concat(string_split(p_name, ' '), [p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'RENEWED' ELSE p_type END])) AS item FROM part)"""


def _changed(spark, sf_dir):
    renewed = F.when(F.col("p_partkey") % 3 == 0, F.lit("RENEWED")).otherwise(F.col("p_type"))
    return with_filter(spread(spark, sf_dir).withColumn("p_type", renewed), part_items(), SHAPE)


@query(f"""
WITH {CHANGED}, {_bits('olds', 'ob')}, {_bits('news', 'nb')},
o AS (SELECT k, bit // 8 AS position, bit_or(1 << (bit % 8)::INT)::BIGINT AS code FROM ob GROUP BY ALL),
n AS (SELECT k, bit // 8 AS position, bit_or(1 << (bit % 8)::INT)::BIGINT AS code FROM nb GROUP BY ALL)
SELECT k AS p_partkey, position, code, 'delete' AS op FROM (SELECT * FROM o EXCEPT SELECT * FROM n)
UNION ALL SELECT k, position, code, 'insert' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""")
def index_update_diff(spark, sf_dir):
    changes = maintain.diff(parts(spark, sf_dir), _changed(spark, sf_dir), KEY)
    return changes.select("p_partkey", F.col("position").cast("long").alias("position"), F.col("code").cast("long").alias("code"), "op")


@query(f"""
WITH {CHANGED}, {_bits('news')}, {_wanted('RENEWED')}, {HITS} SELECT p_partkey FROM hits""")
def index_update_search(spark, sf_dir):
    old = parts(spark, sf_dir)
    index = maintain.apply_diff(C.chunks(old, KEY), maintain.diff(old, _changed(spark, sf_dir), KEY), KEY)
    return C.search(index, KEY, target("RENEWED"))


@query(f"{SEARCH} SELECT path, p_partkey FROM hits, (VALUES ('chunks'), ('slices')) v(path) WHERE p_partkey % 5 <> 0")
def index_delete(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    gone = rows.where("p_partkey % 5 = 0")
    kept = maintain.delete(C.chunks(rows, KEY), gone, KEY)
    live = maintain.release(S.busy(rows), gone)
    a, t = C.search(kept, KEY, target(*TARGET)), target(*TARGET)
    b = S.resolve(S.search(S.slices(rows), live, t, SHAPE), rows, KEY)
    return a.select(F.lit("chunks").alias("path"), "p_partkey").union(b.select(F.lit("slices"), "p_partkey"))


@query(f"{SEARCH} SELECT p_partkey FROM hits WHERE p_partkey < 100 OR p_partkey > 300")
def index_delete_range(spark, sf_dir):
    return C.search(maintain.delete_range(C.chunks(parts(spark, sf_dir), KEY), F.col("p_partkey").between(100, 300)), KEY, target(*TARGET))


LAST = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"


def _typed(df: DataFrame) -> DataFrame:
    return with_filter(df, F.array("event_type"), SHAPE)


@query(f"SELECT user_id FROM ({LAST}) WHERE event_type = 'purchase'")
def index_upsert_lww(spark, sf_dir):
    key, order = ["user_id"], ["ts", "event_id"]
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    first = maintain.latest(events.where("event_id % 2 = 0"), key, order)
    last = maintain.latest(first.unionByName(events.where("event_id % 2 = 1")), key, order)
    written = last.join(first, [*key, *order], "left_anti")
    index = maintain.upsert(C.chunks(_typed(first), key), _typed(written), key)
    return C.search_verified(last, index, key, target("purchase"), F.col("event_type") == "purchase").select("user_id")


@query("""
WITH e AS (SELECT event_id, event_type, floor(epoch(ts))::BIGINT AS sec, CASE WHEN event_id % 10 <> 0 THEN 3600 * (event_id % 480 + 1) END AS ttl FROM events)
SELECT event_id FROM e WHERE event_type = 'error' AND (ttl IS NULL OR sec + ttl > (SELECT max(sec) FROM e))""")
def index_ttl_live(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ttl", F.when(F.col("event_id") % 10 != 0, 3600 * (F.col("event_id") % 480 + 1)))
    now = events.agg(F.max("ts").alias("now")).first()["now"]
    rows = maintain.live(events, F.lit(now))
    index = C.chunks(_typed(rows), ["event_id"])
    return C.search_verified(rows, index, ["event_id"], target("error"), F.col("event_type") == "error").select("event_id")


@query(f"WITH {PART}, {CHUNKS} SELECT code, count(*) AS n FROM chunks GROUP BY code")
def index_stats(spark, sf_dir):
    return keyed(C.code_histogram(C.chunks(parts(spark, sf_dir), KEY)), "code", "n")


@query(f"WITH {PART}, {CHUNKS}, e AS (SELECT count(*) AS n FROM chunks GROUP BY p_partkey) SELECT sum(n)::BIGINT AS total, avg(n) AS mean, min(n) AS least, max(n) AS most FROM e")
def index_stats_summary(spark, sf_dir):
    return C.chunk_statistics(C.chunks(parts(spark, sf_dir), KEY), KEY)


@query(f"WITH {PART}, {CHUNKS} SELECT count(*) AS entries, floor(count(*) / least(128 - 128 * pow(127 / 128.0, 16), 16) + 0.5)::BIGINT AS estimate FROM chunks")
def estimate_rows(spark, sf_dir):
    ratio = ChunkOptions.parse({"numberOfBits": "128", "numberOfItems": "4", "numberOfFunctions": "4"}).ratio
    entries = C.chunks(parts(spark, sf_dir), KEY).agg(F.count(F.lit(1)).alias("entries"))
    return entries.select("entries", shapes.estimate_rows(F.col("entries"), ratio, F.lit(-1)).alias("estimate"))


@query(f"""
WITH {PART}, titems AS (SELECT DISTINCT p_brand AS k, p_brand AS item FROM part), {_bits('titems', 'tbits')}, n AS (SELECT k, count(*) AS n FROM tbits GROUP BY k),
c AS (SELECT t.k AS p_brand, b.k AS p_partkey FROM tbits t JOIN bits b USING (bit) JOIN n ON n.k = t.k GROUP BY ALL HAVING count(*) = any_value(n.n))
SELECT c.p_brand, count(*) AS candidates, count(*) FILTER (WHERE p.p_brand = c.p_brand) AS exact, count(*) FILTER (WHERE p.p_brand <> c.p_brand) AS false_positives
FROM c JOIN part p USING (p_partkey) GROUP BY c.p_brand""")
def fpp_report(spark, sf_dir):
    found = chunk_search_multi(spark, sf_dir).join(table(spark, sf_dir, "part"), "p_partkey")
    same = F.col("p_brand") == F.col("query_id")
    return found.groupBy(F.col("query_id")).agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(same, 1)).alias("exact"), F.count(F.when(~same, 1)).alias("false_positives")).withColumnRenamed("query_id", "p_brand")


@query("SELECT 0::BIGINT AS missed")
def no_false_negatives(spark, sf_dir):
    exact = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("query_id"))
    return exact.join(chunk_search_multi(spark, sf_dir), ["p_partkey", "query_id"], "left_anti").agg(F.count(F.lit(1)).alias("missed"))


SLOTS = "slots AS (SELECT c_custkey AS block, (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 0 END) AS flags, 16 + c_custkey * 37 % 200 AS alloc, c_custkey * 37 % 230 AS len FROM customer)"


def _slots(spark, sf_dir):
    k = F.col("c_custkey")
    flags = F.when(k % 3 == 0, 1).otherwise(0) + F.when(k % 11 == 0, 2).otherwise(0)
    return table(spark, sf_dir, "customer").select(k.alias("block"), flags.alias("flags"), (k * 256).alias("offset"), (k * 37 % 230).alias("len"), (16 + k * 37 % 200).alias("alloc"))


@query(f"""
WITH {SLOTS}, r AS (SELECT unnest([10, 50, 100, 150, 200, 500]) AS request)
SELECT request::BIGINT AS request, block, alloc FROM (
  SELECT request, block, alloc, row_number() OVER (PARTITION BY request ORDER BY alloc, block) AS n FROM r, slots
  WHERE flags & 1 = 1 AND flags & 2 = 0 AND alloc >= len AND alloc >= request) WHERE n = 1""")
def bestfit_slot(spark, sf_dir):
    free = _slots(spark, sf_dir)
    return flow.and_then(*[slots.best_fit(free, n).select(F.lit(n).cast("long").alias("request"), "block", "alloc") for n in (10, 50, 100, 150, 200, 500)])


@query(f"WITH {PART}, {IDS} SELECT idx AS index, CASE WHEN ids.k % 10 = 0 THEN 'true' ELSE 'false' END AS deleted, '0x' || hex AS filter FROM {_hex('bits')} h JOIN ids USING (k)")
def dump_filters(spark, sf_dir):
    return dumps.filter_rows(_numbered(spark, sf_dir).withColumn("deleted", F.col("p_partkey") % 10 == 0))


@query(f"""
WITH {IDS}, e AS (SELECT idx, idx % 5 <> 0 AS initialised, CASE WHEN idx % 5 <> 0 THEN idx END AS reference FROM ids),
s AS (SELECT idx AS block, (CASE WHEN idx % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN idx % 11 = 0 THEN 2 ELSE 0 END) AS flags, idx * 32 AS "offset", length(p_name) AS len, 12 AS alloc, p_name AS key FROM ids JOIN part ON p_partkey = k)
SELECT idx AS index, initialised AS initialized, reference, coalesce(flags & 2 = 0, false) AS idx_init, coalesce(flags = 1 AND alloc >= len, false) AS available,
       coalesce(flags & 1 = 1, false) AS deleted, coalesce(alloc < len, false) AS invalid, len AS used, CASE WHEN block IS NOT NULL THEN alloc END::BIGINT AS allocated, "offset",
       hex(encode(key)) AS hex, key AS char FROM e LEFT JOIN s ON reference = block""")
def dump_key_chain(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    idx = F.col("idx")
    ids = rows.select("idx", (idx % 5 != 0).alias("initialised"), F.when(idx % 5 != 0, idx).alias("reference"))
    flags = F.when(idx % 7 == 0, 1).otherwise(0) + F.when(idx % 11 == 0, 2).otherwise(0)
    held = rows.select(idx.alias("block"), flags.alias("flags"), (idx * 32).alias("offset"), F.length("p_name").cast("long").alias("len"), F.lit(12).cast("long").alias("alloc"))
    return slots.key_chain(ids, held, rows.select(idx.alias("block"), F.col("p_name").cast("binary").alias("key")))


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND list_contains(string_split(text, ' '), 'and')")
def phrase_search_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = chunks_of_items(docs, ["doc_id"], words(F.col("text")), WIDE)
    own = F.split("text", " ")
    exact = F.array_contains(own, "the") & F.array_contains(own, "and")
    return C.search_verified(docs, index, ["doc_id"], target("the", "and", shape=WIDE), exact).select("doc_id")


@query("""
WITH a AS (SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')), b AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')
SELECT 'union' AS op, p_partkey FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', p_partkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', p_partkey FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def dedup_union_intersect(spark, sf_dir):
    base = parts(spark, sf_dir)
    index = C.chunks(base, KEY)
    a = C.search_verified(base, index, KEY, target("ring"), F.array_contains(F.split("p_name", " "), "ring")).select("p_partkey")
    b = C.search_verified(base, index, KEY, target("Brand#2"), F.col("p_brand") == "Brand#2").select("p_partkey")
    named = lambda op, df: df.select(F.lit(op).alias("op"), "p_partkey")
    return flow.and_then(named("union", flow.unique(flow.and_then(a, b))), named("intersect", a.intersect(b)), named("except", a.subtract(b)))


@query(f"WITH {PART}, {_wanted('ring')}, {HITS} SELECT p_partkey::VARCHAR AS key FROM part WHERE p_partkey::VARCHAR > '1' AND p_partkey::VARCHAR < '35' AND p_partkey IN (SELECT p_partkey FROM hits)")
def range_scan_contains(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("key", F.col("p_partkey").cast("string"))
    return rows.where("key > '1' and key < '35'").where(B.bf_contains_words(F.col("filter"), target("ring"))).select("key")


@query(f"{SEARCH} SELECT p_partkey FROM part WHERE p_partkey IN (SELECT p_partkey FROM hits) AND p_size > 10")
def datasource_eq_pushdown(spark, sf_dir):
    filter_source.register(spark)
    folder = workspace(spark, "source")
    parts(spark, sf_dir).select("p_partkey", "p_size", "filter").write.parquet(folder)
    rows = spark.read.format("bloom").option("path", folder).load()
    return rows.where((F.col("filter") == F.lit(bytearray(target(*TARGET)))) & (F.col("p_size") > 10)).select("p_partkey")


@query(f"{SEARCH} SELECT p_partkey FROM hits")
def gated_search(spark, sf_dir):
    base = with_filter(spread(spark, sf_dir), part_items(), SHAPE)
    return C.search_chain(kept_index(C.chunks(base, KEY), "gated"), KEY, target(*TARGET))


@query(f"{SEARCH} SELECT p_partkey FROM hits")
def chunk_index_stored(spark, sf_dir):
    base = parts(spark, sf_dir)
    return ChunkIndex(spark, workspace(spark, "chunks"), KEY).build(base).search(target(*TARGET))


@query(f"{SEARCH} SELECT p_partkey FROM hits")
def slice_index_stored(spark, sf_dir):
    return SliceIndex(spark, workspace(spark, "slices"), KEY, SHAPE).build(parts(spark, sf_dir)).search(target(*TARGET))


@query(f"SELECT user_id, event_type FROM ({LAST}) WHERE event_type IN ('purchase')")
def stream_index_maintenance(spark, sf_dir):
    folder = workspace(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    kept = StreamedIndex(spark, folder, ["user_id"], ["ts", "event_id"], _typed)
    kept.run(stream.select("user_id", "ts", "event_id", "event_type"), f"{folder}/checkpoint").awaitTermination()
    return C.search_verified(kept.rows(), kept.index(), ["user_id"], target("purchase"), F.col("event_type") == "purchase").select("user_id", "event_type")


@query("""
SELECT * FROM (VALUES ('1', 'Las Vegas', 'US', '00004010100000044000001004000100100004055555004004040100000040400000004040100000'),
 ('2', 'Xixerella', '', '80002020000A000000800020000A0000008000200008020080802000080002000000200008000200'), ('3', '', 'AD', '00410000041000000000410000041000104000010000041000104000010400000000104000010400')) v(geonameid, name, country_code, filter)""")
def geonames_roundtrip(spark, sf_dir):
    row = lambda i, name, country: (i, name, name, "", *[""] * 4, country, *[""] * 10)
    folder = workspace(spark, "tsv")
    geonames.write_tsv(spark.createDataFrame([row("1", "Las Vegas", "US"), row("2", "Xixerella", ""), row("3", "", "AD")], geonames.SCHEMA), folder)
    back = geonames.with_filters(geonames.read_tsv(spark, folder))
    return back.select("geonameid", "name", "country_code", F.hex("filter").alias("filter"))


@query()
def shuffle_sample(spark, sf_dir):
    return flow.random_order(table(spark, sf_dir, "part").select("p_partkey"), 7).limit(100)


from siftlake.plans import more_queries  # noqa: E402,F401  registers its queries
