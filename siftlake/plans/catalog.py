"""Index tables on storage: build, change, reload, compact, truncate, drop, and the choice between index and scan.

A stored index is a list of generations, each written by one job, and a note (:class:`Versions`) of which ones hold. A
change writes a generation of what it concerns and nothing else; :meth:`compact` merges them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.filters import adjust, bf_contains_words, bits_of_bytes, bytes_of_bits, checked, decode_words
from siftlake.functions.options import MOST_BYTES, ChunkOptions, SliceOptions
from siftlake.functions.shape import Shape
from siftlake.operators import chunks as C
from siftlake.operators import maintain
from siftlake.operators import slices as S
from siftlake.plans.storage import Versions, exists, remove, size

#: Filters up to which reading all of them is as good as an index, and bytes of an index that stand for so many.
SCAN_ROWS, SCAN_BYTES = 1000, 1 << 18
#: Generations from which a change merges them.
MOST_GENERATIONS = 8


class _Stored:
    """What both kinds of index share: their generations."""

    spark: SparkSession
    path: str

    @property
    def _versions(self) -> Versions:
        return Versions(self.spark, f"{self.path}/versions")

    def _note(self) -> tuple[int, dict]:
        return self._versions.read() or (-1, {"generations": []})

    def _put(self, generations: list, **more) -> None:
        number, _ = self._note()
        self._versions.write(number + 1, {"generations": generations, **more})
        self._versions.forget()

    def _folder(self) -> str:
        return f"{self.path}/g{uuid.uuid4().hex}"

    def built(self) -> bool:
        return exists(self.spark, f"{self.path}/versions")

    def bytes(self) -> int:
        return size(self.spark, self.path)

    def truncate(self) -> None:
        """No rows any more; the index stays."""
        _, note = self._note()
        self._put([])
        self._discard(note["generations"])

    def drop(self) -> None:
        remove(self.spark, self.path)

    @contextmanager
    def _kept(self, rows: DataFrame):
        """``rows`` written below the index for as long as a change reads them, which is several times."""
        folder = f"{self.path}/change-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(folder)
            yield self.spark.read.parquet(folder)
        finally:
            remove(self.spark, folder)

    def _discard(self, generations: list) -> None:
        for g in generations:
            remove(self.spark, g if isinstance(g, str) else g["folder"])


@dataclass
class ChunkIndex(_Stored):
    """A chunk index below ``path``. A generation has index rows, partitioned by position and sorted by code, the keys
    that have any, and the keys whose rows in earlier generations are gone.

    ``partition``: columns of the key that name a whole partition, for searches of that granularity.
    """

    spark: SparkSession
    path: str
    key: Sequence[str]
    options: ChunkOptions = ChunkOptions()
    partition: Sequence[str] = ()

    def build(self, base: DataFrame, data: str = "filter") -> ChunkIndex:
        """One batch job; skipped if the index is there or the base table is empty."""
        if not self.built() and not base.isEmpty():
            self._add(base, None, data)
        return self

    def _add(self, rows: DataFrame | None, gone: DataFrame | None, data: str = "filter") -> None:
        folder, (_, note) = self._folder(), self._note()
        if rows is not None:
            index = C.chunks(rows.withColumn(data, checked(F.col(data))), self.key, data)
            index.repartition("position", "code").sortWithinPartitions("position", "code").write.partitionBy("position").parquet(f"{folder}/rows")
            rows.where(F.exists(decode_words(F.col(data)), lambda w: w != 0)).select(*self.key).write.parquet(f"{folder}/keys")
        if gone is not None:
            gone.select(*self.key).distinct().write.parquet(f"{folder}/gone")
        self._put([*note["generations"], folder])
        if len(note["generations"]) + 1 > MOST_GENERATIONS:
            self.compact()

    def table(self) -> DataFrame:
        """Index rows that hold: of each generation, those whose keys no later one has done away with.

        Filters on position and code reach each generation's scan, so a search joins few rows with the keys gone.
        """
        out = self._holding(lambda folder: self.spark.read.parquet(f"{folder}/rows").select(*self.key, F.col("position").cast("int").alias("position"), "code"))
        if out is None:
            fields = ", ".join(f"`{k}` {t}" for k, t in self._key_types().items())
            out = self.spark.createDataFrame([], f"{fields}, position int, code int")
        return out

    def keys(self) -> DataFrame:
        """Keys that have index rows, by a row a key instead of one for each byte of its filter."""

        def of(folder: str) -> DataFrame:
            stored = size(self.spark, f"{folder}/keys") > 0  # a generation written before keys were has none
            return self.spark.read.parquet(f"{folder}/{'keys' if stored else 'rows'}").select(*self.key)

        out = self._holding(of)
        return self.table().select(*self.key) if out is None else out

    def _holding(self, read) -> DataFrame | None:
        """What ``read`` gives of each generation's folder, without the keys that later ones have done away with."""
        _, note = self._note()
        out, gone = None, None
        for folder in reversed(note["generations"]):
            if size(self.spark, f"{folder}/rows"):  # a partitioned table without rows has no files
                rows = read(folder)
                rows = rows if gone is None else rows.join(gone, list(self.key), "left_anti")
                out = rows if out is None else out.unionByName(rows)
            if size(self.spark, f"{folder}/gone"):
                keys = self.spark.read.parquet(f"{folder}/gone").select(*self.key)
                gone = keys if gone is None else gone.union(keys)
        return out

    def _key_types(self) -> dict[str, str]:
        _, note = self._note()
        for folder in note["generations"]:
            for name in ("rows", "gone"):
                if size(self.spark, f"{folder}/{name}"):
                    schema = self.spark.read.parquet(f"{folder}/{name}").schema
                    return {k: schema[k].dataType.simpleString() for k in self.key}
        return {k: "string" for k in self.key} | note.get("key", {})

    def insert(self, rows: DataFrame, data: str = "filter") -> None:
        """Write rows (key, filter): whatever their keys had goes. Keys that are new are just added."""
        with self._kept(rows.select(*self.key, data)) as kept:
            self._add(kept, kept, data)

    def update(self, rows: DataFrame, data: str = "filter") -> None:
        """The same for those keys only that the index has."""
        self.insert(rows.join(self.keys(), list(self.key), "left_semi"), data)

    def delete(self, keys: DataFrame) -> None:
        """Do away with keys, or with whole partitions if ``keys`` has only their columns."""
        if set(self.key) - set(keys.columns):
            named = [k for k in self.key if k in keys.columns]
            keys = self.keys().join(keys.select(*named), named, "left_semi")
        self._add(None, keys)

    def delete_range(self, condition: Column) -> None:
        self._add(None, self.table().where(F.coalesce(condition, F.lit(False))).select(*self.key))

    def compact(self) -> None:
        """One generation of all that holds."""
        _, note = self._note()
        folder = self._folder()
        self.table().repartition("position", "code").sortWithinPartitions("position", "code").write.partitionBy("position").parquet(f"{folder}/rows")
        self.keys().distinct().write.parquet(f"{folder}/keys")
        self._put([folder], key=self._key_types())
        self._discard(note["generations"])

    def truncate(self) -> None:
        _, note = self._note()
        self._put([], key=self._key_types())
        self._discard(note["generations"])

    def search(self, target: bytes, granularity: str = "row") -> DataFrame:
        """Keys whose filters contain ``target``; with granularity ``partition`` those of partitions whose rows do together."""
        check_target(target)
        key = self._columns(granularity)
        by = C.search_chain if self.options.gated else C.search
        return by(self.table(), key, target, self.options.zero_target)

    def _columns(self, granularity: str) -> list[str]:
        if granularity not in ("row", "partition") or (granularity == "partition" and not self.partition):
            raise ValueError("granularity is row, or partition where the index knows the columns of a partition")
        return list(self.partition if granularity == "partition" else self.key)

    def scan(self, base: DataFrame, target: bytes, data: str = "filter") -> DataFrame:
        """Base rows that the index would find, by reading all filters."""
        if not C.target_chunks(target):
            return base.where(F.lit(self.options.zero_target == "all"))
        whole = target[: len(target) // 8 * 8]
        while whole.endswith(bytes(8)):
            whole = whole[:-8]
        return base.where(bf_contains_words(F.col(data), whole))

    def estimated_rows(self, base_rows: int = -1) -> int:
        from siftlake.functions.shape import estimate_rows

        entries = self.table().agg(F.count(F.lit(1)).alias("n"))
        return entries.select(estimate_rows(F.col("n"), self.options.ratio, F.lit(base_rows)).alias("n")).first()["n"]


@dataclass
class SliceIndex(_Stored):
    """A bit-sliced index below ``path``. A generation is whole by itself: ids (key, idx), slices, and busy, which tells what
    of it still holds. Ids are shared by all generations; an id is live in one of them at most.

    A change writes the filters concerned as a new generation and takes their ids out of the busy words of earlier ones,
    which are a bit a row. No slice is ever rewritten but by :meth:`compact`.
    """

    spark: SparkSession
    path: str
    key: Sequence[str]
    shape: Shape
    options: SliceOptions | None = None

    def build(self, base: DataFrame, data: str = "filter") -> SliceIndex:
        if not self.built() and not base.isEmpty():
            rows = S.ranked(self._rows(base, data), self.key[0])
            self._put([self._write(rows)])
        return self

    def _rows(self, base: DataFrame, data: str) -> DataFrame:
        return base.where(F.col(data).isNotNull()).select(*self.key, checked(F.col(data), self.shape).alias("filter"))

    def _write(self, rows: DataFrame) -> dict:
        folder = self._folder()
        rows.write.parquet(f"{folder}/filters")
        filters = self.spark.read.parquet(f"{folder}/filters")
        filters.select(*self.key, "idx").write.parquet(f"{folder}/ids")
        S.slices(filters).repartitionByRange("bit", "block").sortWithinPartitions("bit", "block").write.parquet(f"{folder}/slices")
        S.busy(filters).write.parquet(f"{folder}/busy")
        remove(self.spark, f"{folder}/filters")
        return {"folder": folder, "busy": f"{folder}/busy"}

    def _generations(self) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
        """(ids, slices, busy) of each."""
        _, note = self._note()
        return [tuple(self.spark.read.parquet(p) for p in (f"{g['folder']}/ids", f"{g['folder']}/slices", g["busy"])) for g in note["generations"]]

    def table(self, name: str) -> DataFrame:
        """ids, slices or busy over all generations: only what is live."""
        out = None
        for ids, matrix, busy in self._generations():
            if name == "ids":
                held = busy.withColumnRenamed("block", "__block").withColumnRenamed("word", "__word")  # a row for 64 ids
                at = ids.join(held, (F.col("idx") / 64).cast("long") == F.col("__block"))
                part = at.where(F.getbit("__word", (F.col("idx") % 64).cast("int")) == 1).select(*ids.columns)
            elif name == "busy":
                part = busy
            else:
                part = matrix.join(busy.withColumnRenamed("word", "live"), "block").select("block", "bit", F.col("word").bitwiseAND(F.col("live")).alias("word")).where("word <> 0")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("the index is empty: it has no tables")
        if name == "ids":
            return out
        by = ["block"] if name == "busy" else ["block", "bit"]
        return out.groupBy(*by).agg(F.bit_or("word").alias("word"))

    def search(self, target: bytes) -> DataFrame:
        """Keys whose filters contain ``target``: each generation is searched with its own slices, busy words and ids."""
        check_target(target)
        zero = self.options.zero_target if self.options else "all"
        found = [S.resolve(S.search(matrix, busy, target, self.shape, zero), ids, self.key) for ids, matrix, busy in self._generations()]
        if not found:
            adjust(target, self.shape)
            _, note = self._note()
            return self.spark.createDataFrame([], ", ".join(f"`{k}` {t}" for k, t in note["key"].items()))
        return reduce(DataFrame.unionByName, found)

    def scan(self, base: DataFrame, target: bytes, data: str = "filter") -> DataFrame:
        """Base rows that the index would find, by reading all filters."""
        bits = [b for b in bits_of_bytes(adjust(target, self.shape)) if b < self.shape.m]
        rows = base.where(F.col(data).isNotNull())
        if not bits:
            return rows.where(F.lit((self.options.zero_target if self.options else "all") == "all"))
        return rows.where(bf_contains_words(F.col(data), bytes_of_bits(bits, self.shape)))

    def _released(self, held: DataFrame) -> list[dict]:
        """The generations after the live ids ``held`` (idx) went. Where an id isn't live its bit is 0 already."""
        _, note = self._note()
        out = []
        for g in note["generations"]:
            busy, at = self.spark.read.parquet(g["busy"]), f"{g['folder']}/busy-{uuid.uuid4().hex}"
            maintain.release(busy, held).where("word <> 0").write.parquet(at)
            out.append({"folder": g["folder"], "busy": at})
        return out

    def insert(self, rows: DataFrame, data: str = "filter") -> None:
        """Write rows (key, filter), each key once: a key that is there keeps its id, others get the lowest free ones."""
        new = self._rows(rows, data)
        _, note = self._note()
        if not note["generations"]:
            self._put([self._write(S.ranked(new, self.key[0]))] if not new.isEmpty() else [], key=note.get("key", {}))
            return
        self._change(new.join(self.table("ids"), list(self.key), "left"))

    def update(self, rows: DataFrame, data: str = "filter") -> None:
        """The same for those keys only that the index has."""
        self._change(self._rows(rows, data).join(self.table("ids"), list(self.key)))

    def _change(self, found: DataFrame) -> None:
        """Write ``found`` (key, filter, idx), whose idx is null where the key is new, as a generation."""
        _, note = self._note()
        with self._kept(found.select(*self.key, "filter", "idx")) as kept:
            old, fresh = kept.where(F.col("idx").isNotNull()), kept.where(F.col("idx").isNull()).drop("idx")
            rows = old
            if not fresh.isEmpty():
                if len(self.key) > 1:
                    fresh = fresh.withColumn("__key", F.to_json(F.struct(*self.key)))
                by = "__key" if len(self.key) > 1 else self.key[0]
                given = S.allocate(None, fresh.select(by), by, words=self.table("busy"))
                rows = old.unionByName(fresh.join(given, by).select(*self.key, "filter", "idx"))
            added = self._write(rows)
            self._put([*self._released(old.select("idx")), added])
        if len(note["generations"]) + 1 > MOST_GENERATIONS:
            self.compact()

    def delete(self, keys: DataFrame) -> None:
        """Their ids are free for later keys."""
        _, note = self._note()
        if not note["generations"]:
            self._put([])
            return
        with self._kept(self.table("ids").join(keys.select(*self.key), list(self.key), "left_semi").select("idx")) as held:
            self._put(self._released(held))

    def truncate(self) -> None:
        _, note = self._note()
        kinds = {k: t for k, t in self.table("ids").select(*self.key).dtypes} if note["generations"] else note.get("key", {})
        self._put([], key=kinds)
        self._discard(note["generations"])

    def compact(self) -> None:
        """One generation of all that is live, under the same ids."""
        _, note = self._note()
        folder = self._folder()
        self.table("ids").write.parquet(f"{folder}/ids")
        self.table("slices").repartitionByRange("bit", "block").sortWithinPartitions("bit", "block").write.parquet(f"{folder}/slices")
        self.table("busy").write.parquet(f"{folder}/busy")
        self._put([{"folder": folder, "busy": f"{folder}/busy"}])
        self._discard(note["generations"])

    def estimated_rows(self) -> int:
        _, note = self._note()
        return S.cardinality(self.table("busy")).first()["live"] if note["generations"] else 0


def check_target(target: bytes) -> None:
    if target is None:
        raise ValueError("the target of a search can't be null")
    if len(target) > MOST_BYTES:
        raise ValueError("a target of over 64K can't be asked for")


def search(base: DataFrame, target: bytes, key: Sequence[str], index: ChunkIndex | SliceIndex | None = None, rows: int | None = None, data: str = "filter", residual: Column | None = None) -> DataFrame:
    """Base rows whose filter contains ``target``: by the index, or by reading all filters if there is none or few rows.

    Few are under SCAN_ROWS, or without ``rows`` an index of under SCAN_BYTES. Both ways find the same rows: what a
    target without bits, or of another length, finds is the index's rule.
    """
    check_target(target)
    if index is None:
        found = base.where(bf_contains_words(F.col(data), target))
    elif rows < SCAN_ROWS if rows is not None else index.bytes() < SCAN_BYTES:
        found = index.scan(base, target, data)
    else:
        return C.fetch(base, index.search(target), key, residual)
    return found if residual is None else found.where(residual)
