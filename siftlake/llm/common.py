"""What several corpus operators share: tables in the shared scratch folder, fixed-size row filters, safe column names."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every contract here: `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

#: Bytes of a batch that goes to a Python worker, where the session doesn't say; a larger row is a batch of its own.
BATCH, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_scratch: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, which every executor can see.

    Where that setting is absent, a local session (as in tests) uses a temporary folder, any other the warehouse; a
    warehouse on the machines' own disks raises a ValueError, since other machines wouldn't see what one wrote.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _scratch:
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not root:
            if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
                root = tempfile.mkdtemp(prefix="siftlake-")
            else:
                root = spark.conf.get("spark.sql.warehouse.dir")
                if "://" not in root or root.startswith("file:"):
                    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _scratch[app] = f"{root.rstrip('/')}/siftlake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the session has gone already
        return


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    That cuts the lineage without a copy that dies with an executor, and gives later joins a plain scan on this
    side, so adaptive execution can split a hot key.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialise` that nothing will read again; others are left alone."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            _remove(t.sparkSession, path)


def adds(*names: str) -> Callable:
    """For operators on a first table ``docs`` that add columns ``names``.

    Columns named so already, in any case, are replaced. Columns whose names begin with two underscores, as the
    operators' own working columns do, get other names meanwhile, so that they pass through.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(docs: DataFrame, *args, **how) -> DataFrame:
            docs = docs.drop(*(c for c in docs.columns if c.lower() in {n.lower() for n in names}))
            aside = {c: f"aside{i}_{uuid.uuid4().hex}" for i, c in enumerate(docs.columns) if c.startswith("__")}
            out = f(docs.withColumnsRenamed(aside), *args, **how)
            return out.withColumnsRenamed({v: k for k, v in aside.items()})

        return run

    return wrap


def by_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` by batches of BATCH bytes, after which a worker gives back the memory it has freed.

    Without a bound in bytes a batch is 10000 rows, however long their texts are, and both the executor and the worker
    hold several forms of it. Workers wait for the next task with all that their allocators keep. The bound is a setting
    of the session, set only where it is unset.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)

    return df.mapInArrow(tidy, schema)


def word_pieces(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of the A-Z lower-cased text in UTF-8, those of about ``size`` bytes at a time."""
    data, a = (text or "").encode().lower(), 0  # bytes.lower changes A-Z alone, bytes.split knows [\x20\x09-\x0D]
    while a < len(data):
        if len(data) - a <= size:
            yield data[a:].split()
            return
        cut = _BLANK.search(data, a + size)
        b = cut.start() if cut else len(data)
        yield data[a:b].split()
        a = b


def without_blanks(text: Column) -> Column:
    """``text`` without any white space; null counts as empty."""
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def slot_filter(keys: DataFrame, key: str, slots: int) -> DataFrame:
    """A bitmap of ``slots`` bits holding the 64-bit column ``key``, as rows (word_no, bits).

    It has slots / 64 rows at most, whatever the input, so it may be broadcast. It never misses a key that it
    holds; other keys may seem present, so an exact test has to follow.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(slots))
    return keys.select((slot / 64).cast("long").alias("__word_no"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("b")).groupBy("__word_no").agg(F.bit_or("b").alias("__bits"))


def flag_in_filter(df: DataFrame, key: str, found: DataFrame, slots: int, flag: str) -> DataFrame:
    """Adds the boolean ``flag``: whether :func:`slot_filter` may hold the row's ``key``."""
    slot = F.pmod(F.xxhash64(key), F.lit(slots))
    out = df.withColumns({"__slot_word": (slot / 64).cast("long"), "__slot_bit": (slot % 64).cast("int")})
    out = out.join(F.broadcast(found), out["__slot_word"] == found["__word_no"], "left")
    return out.withColumn(flag, F.coalesce(F.getbit("__bits", "__slot_bit") == 1, F.lit(False))).drop("__slot_word", "__slot_bit", "__word_no", "__bits")
