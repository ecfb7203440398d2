"""Registered queries of operators that change, reload or describe indexes, with their SQL; added to those of :mod:`queries`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions import filters as B
from siftlake.functions.options import ChunkOptions, SliceOptions, parse_bool, parse_int
from siftlake.operators import chunks as C
from siftlake.operators import flow, slots
from siftlake.operators import slices as S
from siftlake.operators.items import chunks_of_items, words
from siftlake.plans import catalog, console
from siftlake.plans.catalog import ChunkIndex, SliceIndex
from siftlake.plans.queries import CHANGED, CHUNKS, HITS, IDS, KEY, LAST, PART, SEARCH, SHAPE, TARGET, WIDE, _bits, _changed, _numbered, _typed, _wanted, kept, kept_index, keyed, parts, query, stored_parts, table, target
from siftlake.plans.workspace import workspace
from siftlake.sources import filter_source, geonames
from siftlake.streaming.maintain import StreamedIndex

PATHS = "(VALUES ('chain'), ('chunks'), ('many'), ('scan'), ('slices'), ('stored')) v(path)"


def _named(path: str, df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.lit(path).alias("path"), *(columns or KEY))


@query(f"{SEARCH} SELECT path, p_partkey FROM hits, {PATHS} WHERE path NOT IN ('scan', 'slices')")
def search_repeated_keys(spark, sf_dir):
    """Every key has each of its index rows three times over, and is found once by every path."""
    base = stored_parts(spark, sf_dir, "repeated-base")
    index, t = kept_index(C.chunks(flow.and_then(base, base, base), KEY), "repeated-chain"), target(*TARGET)
    stored = ChunkIndex(spark, workspace(spark, "repeated"), KEY).build(flow.and_then(base, base))
    asked = spark.createDataFrame([(0, bytearray(t))], "query_id int, target binary")
    found = {"chunks": C.search(index, KEY, t), "chain": C.search_chain(index, KEY, t), "many": C.search_many(index, KEY, asked), "stored": stored.search(t)}
    return reduce(DataFrame.unionByName, (_named(n, d) for n, d in found.items()))


@query(f"""
WITH {PART}, {_wanted('ring', 'small')}, {CHUNKS}, t AS (SELECT bit // 8 AS position, bit_or(1 << (bit % 8)::INT)::BIGINT AS code FROM tbits GROUP BY ALL),
b AS (SELECT DISTINCT p_brand, c.position FROM chunks c JOIN t ON c.position = t.position AND c.code & t.code = t.code JOIN part USING (p_partkey))
SELECT p_brand FROM b GROUP BY p_brand HAVING count(*) = (SELECT count(*) FROM t)""")
def search_partition_granularity(spark, sf_dir):
    """Partitions (brands) whose rows (parts) fit the target together, maybe different ones at different positions."""
    stored = ChunkIndex(spark, workspace(spark, "partition"), ["p_brand", "p_partkey"], partition=["p_brand"]).build(parts(spark, sf_dir))
    return stored.search(target("ring", "small"), "partition")


@query("SELECT 'slices' AS path, p_partkey FROM part UNION ALL SELECT 'slices, scanned', p_partkey FROM part")
def search_zero_target_paths(spark, sf_dir):
    """A target without bits finds by index what it finds by scan: nothing by chunks, all by slices."""
    base, t = stored_parts(spark, sf_dir, "zero"), bytes(16)
    chunked, sliced = ChunkIndex(spark, workspace(spark, "zero-chunks"), KEY).build(base), SliceIndex(spark, workspace(spark, "zero-slices"), KEY, SHAPE).build(base)
    found = [_named(n + how, catalog.search(base, t, KEY, index, rows)) for n, index in (("chunks", chunked), ("slices", sliced)) for how, rows in (("", 10**6), (", scanned", 1))]
    return reduce(DataFrame.unionByName, found)


@query(f"{SEARCH} SELECT path, p_partkey FROM hits, (VALUES ('chunks'), ('chunks, scanned'), ('slices'), ('slices, scanned'), ('measured')) v(path)")
def planner_choice(spark, sf_dir):
    base, t = stored_parts(spark, sf_dir, "choice"), target(*TARGET)
    chunked, sliced = ChunkIndex(spark, workspace(spark, "choice-chunks"), KEY).build(base), SliceIndex(spark, workspace(spark, "choice-slices"), KEY, SHAPE).build(base)
    found = [_named(n + how, catalog.search(base, t, KEY, index, rows)) for n, index in (("chunks", chunked), ("slices", sliced)) for how, rows in (("", 10**6), (", scanned", 1))]
    return reduce(DataFrame.unionByName, [*found, _named("measured", catalog.search(base, t, KEY, chunked))])


#: Parts divisible by 3 get another type, those divisible by 5 go, and those divisible by 10 come back under a new key.
CHANGES = f"""
WITH {CHANGED}, {_bits('news')}, {_wanted('RENEWED')}, {HITS}
SELECT p_partkey FROM hits WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey + 10000000 FROM hits WHERE p_partkey % 10 = 0"""


def _lived(index, spark, sf_dir):
    """Build, update, delete, insert and compact through objects of their own, so that each finds what the last one wrote."""
    old, new = stored_parts(spark, sf_dir, "lived-old"), kept(_changed(spark, sf_dir).select(*KEY, "filter"), "lived-new")
    index().build(old)
    index().update(new.where("p_partkey % 3 = 0"))
    index().update(new.select((-F.col("p_partkey") - 1).alias("p_partkey"), "filter"))  # not there: nothing comes of it
    index().delete(old.where("p_partkey % 5 = 0"))
    index().insert(new.where("p_partkey % 10 = 0").select((F.col("p_partkey") + 10_000_000).alias("p_partkey"), "filter"))
    before = index().search(target("RENEWED")).count()
    index().compact()
    found = index().search(target("RENEWED"))
    if found.count() != before:
        raise AssertionError("compaction changes what is found")
    return found


@query(CHANGES)
def stored_chunk_changes(spark, sf_dir):
    folder = workspace(spark, "changed-chunks")
    return _lived(lambda: ChunkIndex(spark, folder, KEY), spark, sf_dir)


@query(CHANGES)
def stored_slice_changes(spark, sf_dir):
    folder = workspace(spark, "changed-slices")
    return _lived(lambda: SliceIndex(spark, folder, KEY, SHAPE), spark, sf_dir)


@query("SELECT path, kept::BIGINT AS kept FROM (VALUES ('chunks', 0), ('slices', 0)) v(path, kept)")
def stored_truncate(spark, sf_dir):
    base = stored_parts(spark, sf_dir, "cut")
    both = {"chunks": ChunkIndex(spark, workspace(spark, "cut-chunks"), KEY), "slices": SliceIndex(spark, workspace(spark, "cut-slices"), KEY, SHAPE)}
    out = []
    for name, index in both.items():
        index.build(base).truncate()
        out.append(index.search(target(*TARGET)).agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("path"), "kept"))
    return reduce(DataFrame.unionByName, out)


@query(f"""WITH {PART}, {CHUNKS} SELECT p_partkey, position, code, printf('%08X%08X', position, code) AS key_bytes, 'IndexKey[' || position || ', 0x' || printf('%02x', code) || ']' AS key,
  position = 3 AND code = 4 AS equal FROM chunks""")
def chunk_key_forms(spark, sf_dir):
    """A key as bytes, as text, as a value of its own and compared with another."""
    index = C.chunks(parts(spark, sf_dir), KEY)
    value = index.select(C.index_value(KEY).alias("v"), C.key_bytes(F.col("position"), F.col("code")).alias("b"), C.key_text(F.col("position"), F.col("code")).alias("key"))
    same = F.struct("v.position", "v.code") == F.struct(F.lit(3).alias("position"), F.lit(4).alias("code"))
    return value.select(F.col("v.p_partkey").alias("p_partkey"), F.col("v.position").cast("long").alias("position"), F.col("v.code").cast("long").alias("code"), F.hex("b").alias("key_bytes"), "key", same.alias("equal"))


@query(f"WITH {PART}, {CHUNKS} SELECT 'position' AS read, p_partkey, code FROM chunks WHERE position = 3 UNION ALL SELECT 'entry', p_partkey, code FROM chunks WHERE position = 3 AND code = 4")
def index_entries(spark, sf_dir):
    index = ChunkIndex(spark, workspace(spark, "entries"), KEY).build(parts(spark, sf_dir)).table()
    read = lambda name, df: df.select(F.lit(name).alias("read"), "p_partkey", F.col("code").cast("long").alias("code"))
    return read("position", C.entries(index, 3)).union(read("entry", C.entries(index, 3, 4)))


@query("""
SELECT * FROM (VALUES ('bits', '302'), ('missing', '0'), ('broken', 'ValueError'), ('slices', '302'), ('no slices', 'ValueError'), ('ratio', '37.75'), ('no ratio', '0.0'), ('gated', 'true'), ('other word', 'false')) v(option, value)""")
def option_rules(spark, sf_dir):
    def tried(f):
        try:
            return str(f())
        except ValueError:
            return "ValueError"

    whole = {"numberOfBits": "302", "numberOfItems": "10", "numberOfFunctions": "21", "usePrimaryFilter": "Yes"}
    rows = [("bits", tried(lambda: parse_int(whole, "numberOfBits"))), ("missing", tried(lambda: parse_int({}, "numberOfBits"))), ("broken", tried(lambda: parse_int({"numberOfBits": "many"}, "numberOfBits"))), ("slices", tried(lambda: SliceOptions.parse(whole).bits)), ("no slices", tried(lambda: SliceOptions.parse({}).bits)), ("ratio", tried(lambda: round(ChunkOptions.parse(whole).ratio, 2))), ("no ratio", tried(lambda: ChunkOptions.parse({"numberOfBits": "302"}).ratio)), ("gated", tried(lambda: ChunkOptions.parse(whole).gated).lower()), ("other word", tried(lambda: parse_bool("maybe")).lower())]
    return spark.createDataFrame(rows, "option string, value string")


@query("SELECT p_partkey, 16::BIGINT AS bytes FROM part")
def validated_filters(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", F.octet_length(B.checked(F.col("filter"), SHAPE)).cast("long").alias("bytes"))


@query("""
WITH b AS (SELECT c_custkey, c_custkey % 200 AS bit, c_custkey * 7 % 200 AS other FROM customer)
SELECT 'set' AS op, c_custkey, bit FROM b UNION ALL SELECT 'set', c_custkey, other FROM b WHERE other <> bit UNION ALL SELECT 'clear', c_custkey, other FROM b WHERE other <> bit""")
def bitmap_set_clear(spark, sf_dir):
    """Two bits set in an empty bitmap, which grows, and one of them cleared again."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("words", B.with_bit(F.array().cast("array<long>"), k % 200)).withColumn("words", B.with_bit(F.col("words"), k * 7 % 200))
    cleared = rows.withColumn("words", B.with_bit(F.col("words"), k % 200, on=False))
    bits = lambda op, df: df.select(F.lit(op).alias("op"), "c_custkey", F.explode(B.set_bits(F.col("words"))).alias("bit")).withColumn("bit", F.col("bit").cast("long"))
    return bits("set", rows).union(bits("clear", cleared))


def _records(spark, sf_dir):
    row = {"geonameid": F.col("p_partkey").cast("string"), "name": F.col("p_name"), "asciiname": F.col("p_name"), "feature_code": F.col("p_type"), "country_code": F.col("p_brand")}
    return table(spark, sf_dir, "part").select(*[row.get(f, F.lit("")).alias(f) for f in geonames.FIELDS])


@query("""
SELECT 'found' AS read, p_partkey::VARCHAR AS geonameid FROM part WHERE p_brand = 'Brand#2' AND p_type = 'PROMO' UNION ALL SELECT 'by id', '17'""")
def gazetteer_load_find(spark, sf_dir):
    """Text records loaded in bulk to a table and its index, searched by items as the command line does, and read by key."""
    folder = workspace(spark, "gazetteer")
    geonames.write_tsv(_records(spark, sf_dir), f"{folder}/in")
    args = console.options().parse_args([folder, "--load", f"{folder}/in", "--find", "Brand#2", "PROMO"])
    base = geonames.load(spark, args.load, f"{folder}/geonames", f"{folder}/index", args.limit)
    exact = (F.col("country_code") == "Brand#2") & (F.col("feature_code") == "PROMO")
    found = C.search_verified(base, spark.read.parquet(f"{folder}/index"), ["geonameid"], console.target_of(args.find), exact)
    return found.select(F.lit("found").alias("read"), "geonameid").union(geonames.by_id(base, "17").select(F.lit("by id"), "geonameid"))


@query("SELECT least(count(*), 150) AS rows FROM part")
def source_limit(spark, sf_dir):
    folder = workspace(spark, "limit")
    geonames.write_tsv(_records(spark, sf_dir), folder)
    return geonames.read_tsv(spark, folder, 150).agg(F.count(F.lit(1)).alias("rows"))


@query("""
WITH n AS (SELECT n_nationkey::BIGINT AS x, n_name, n_regionkey FROM nation)
SELECT 'map' AS op, x * 2 AS x FROM n UNION ALL SELECT 'keep', x FROM n WHERE x > 10 UNION ALL SELECT 'drop', x FROM n WHERE NOT x > 10 UNION ALL SELECT 'concat', x FROM n, range(2)
UNION ALL SELECT 'flatten', unnest([x, -x]) FROM n UNION ALL SELECT 'map, no nulls', x FROM n WHERE x % 2 = 0 UNION ALL SELECT DISTINCT 'distinct', n_regionkey::BIGINT FROM n
UNION ALL SELECT 'singleton', 4 UNION ALL SELECT 'counted', count(*) FROM n UNION ALL SELECT 'next', 7 UNION ALL SELECT 'next of none', NULL UNION ALL SELECT 'shuffled', x FROM n""")
def flow_vocabulary(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("x"), F.col("n_regionkey").cast("long").alias("r"))
    x, only = F.col("x"), n.select("x")
    rows, seen = flow.counted(only)
    rows.write.format("noop").mode("overwrite").save()
    one = lambda v: flow.singleton(spark, (v,), "x long")
    first = flow.next_row(only.where("x = 7"))["x"]
    none = flow.next_row(flow.empty(spark, "x long"))
    found = {"map": flow.map_with(only, x=x * 2), "keep": flow.filter_keep(only, x > 10), "drop": flow.filter_drop(only, x > 10), "concat": flow.and_then(only, only), "flatten": flow.flatten(n.select(F.array(x, -x).alias("x")), "x"), "map, no nulls": flow.map_filter(only, "x", F.when(x % 2 == 0, x)), "distinct": flow.unique(n.select(F.col("r").alias("x"))), "singleton": one(4), "counted": one(seen.get["count"]), "next": one(first), "next of none": one(none), "shuffled": flow.random_order(only, 3)}
    return reduce(DataFrame.unionAll, (d.select(F.lit(op).alias("op"), "x") for op, d in found.items()))


SLOTTED = f"""WITH {IDS}, s AS (SELECT idx, p_name, length(p_name) AS len, coalesce(sum(length(p_name)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM ids JOIN part ON p_partkey = k)"""


def _loaded(spark, sf_dir):
    rows = _numbered(spark, sf_dir).select("idx", F.col("p_name").cast("binary").alias("key"))
    return slots.load(rows)


@query(f"{SLOTTED} SELECT idx, len, \"offset\", p_name AS key FROM s")
def slot_bulk_load(spark, sf_dir):
    ids, held, keys = _loaded(spark, sf_dir)
    rows = ids.join(held, ids["reference"] == held["block"]).join(keys, "block")
    return rows.select("idx", "len", "offset", F.col("key").cast("string").alias("key"))


@query(f"""{SLOTTED} SELECT 'key' AS what, idx, p_name AS key, NULL::BIGINT AS alloc FROM s WHERE idx % 3 <> 0 UNION ALL SELECT 'free', idx, NULL, len FROM s WHERE idx % 3 = 0
UNION ALL SELECT 'like 4', idx, NULL, NULL FROM s WHERE idx = 4""")
def slot_lifecycle(spark, sf_dir):
    """Keys loaded, some deleted; what is left, the free list built anew, and the map entries that match one."""
    ids, held, keys = _loaded(spark, sf_dir)
    ids, held = slots.delete(ids, held, ids.where("idx % 3 = 0"))
    none = F.lit(None).cast("string"), F.lit(None).cast("long")
    left = slots.get(ids, held, keys).select(F.lit("key").alias("what"), "idx", F.col("key").cast("string").alias("key"), none[1].alias("alloc"))
    free = slots.free_list(held).select(F.lit("free"), "block", none[0], "alloc")
    return left.union(free).union(slots.matching(ids, 4, 4).select(F.lit("like 4"), "idx", *none))


@query(f"SELECT user_id, event_type FROM ({LAST}) WHERE event_type = 'error'")
def stream_index_restart(spark, sf_dir):
    """Two batches by one object, read by another that has seen neither."""
    folder, events = workspace(spark, "restart"), table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    made = lambda: StreamedIndex(spark, folder, ["user_id"], ["ts", "event_id"], _typed, buckets=8)
    made().apply(events.where("event_id % 3 <> 0"), 0)
    made().apply(events.where("event_id % 3 = 0"), 1)
    kept = made()
    return C.search_verified(kept.rows(), kept.index(), ["user_id"], target("error"), F.col("event_type") == "error").select("user_id", "event_type")


@query(f"{SEARCH} SELECT p_partkey FROM part WHERE p_partkey IN (SELECT p_partkey FROM hits) AND p_size > 10")
def datasource_eq_indexed(spark, sf_dir):
    """``=`` answered by the slices beside each file: only those of the target's bits are read, then only rows that hold them."""
    filter_source.register(spark)
    folder = workspace(spark, "indexed")
    parts(spark, sf_dir).select("p_partkey", "p_size", "filter").write.parquet(folder)
    filter_source.index(spark, folder)
    rows = spark.read.format("bloom").option("path", folder).load()
    return rows.where((F.col("filter") == F.lit(bytearray(target(*TARGET)))) & (F.col("p_size") > 10)).select("p_partkey")


@query("""
SELECT 'text' AS kind, count(*) + 1 AS rows, count(*) + 1 AS ids, count(*)::BIGINT AS highest FROM part UNION ALL SELECT 'date', count(DISTINCT o_orderdate::DATE), count(DISTINCT o_orderdate::DATE), count(DISTINCT o_orderdate::DATE)::BIGINT - 1 FROM orders""")
def rank_by_kind(spark, sf_dir):
    """Dense ids of text keys, a null among them, and of dates in their order."""
    text = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k")).union(spark.createDataFrame([(None,)], "k string"))
    dates = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("k")).distinct()
    told = lambda kind, df: S.ranked(df, "k").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("idx").alias("ids"), F.max("idx").alias("highest")).select(F.lit(kind).alias("kind"), "rows", "ids", "highest")
    return told("text", text).union(told("date", dates))


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND list_contains(string_split(text, ' '), 'and')")
def phrase_search_stored(spark, sf_dir):
    """The index of the documents' words is built once and stored; the search reads the target's positions of it alone."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), workspace(spark, "phrases")
    chunks_of_items(docs, ["doc_id"], words(F.col("text")), WIDE).hint("rebalance", "position").sortWithinPartitions("position", "code").write.parquet(folder)
    own = F.split("text", " ")
    exact = F.array_contains(own, "the") & F.array_contains(own, "and")
    return C.search_verified(docs, spark.read.parquet(folder), ["doc_id"], target("the", "and", shape=WIDE), exact).select("doc_id")
