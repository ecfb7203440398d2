"""Index maintenance from a stream of mutations: each micro-batch rewrites the buckets of the keys it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.operators.chunks import chunks
from siftlake.operators.maintain import latest
from siftlake.plans.storage import Versions, remove


class StreamedIndex:
    """The latest row of each key with its filter, and the chunk index, in ``buckets`` of keys below ``path``.

    A batch reads and writes only the buckets of its keys, so its cost follows the batch, not the table; a note names
    the folder of each bucket. A batch that is run again starts from the note before it and writes the same folder anew,
    so retries change nothing. There is one writer. Late rows lose to newer ones by ``order``. The newest note is found
    on storage, so reads go on after a restart. Folders no bucket needs any more are deleted two batches later.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str], filtered: Callable[[DataFrame], DataFrame], deleted: Column | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.filtered, self.deleted, self.buckets = spark, path, list(key), list(order), filtered, deleted, buckets
        self.versions = Versions(spark, f"{path}/versions")

    def _read(self, name: str, note: dict, only: Sequence[int] | None = None) -> DataFrame:
        wanted = {b: v for b, v in note["buckets"].items() if only is None or int(b) in only}
        root = f"{self.path}/data"
        folders = [f"{root}/v{v}/{name}/bucket={b}" for b, v in wanted.items() if name == "rows" or int(b) not in note["bare"]]
        if not folders:
            return self.spark.createDataFrame([], note["schema"][name])
        return self.spark.read.schema(note["schema"][name]).parquet(*folders)

    def apply(self, batch: DataFrame, version: int) -> None:
        before = self.versions.read(below=version)
        note = before[1] if before else {"buckets": {}, "schema": {}, "bare": []}
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        rows = latest(batch, self.key, self.order)
        touched = sorted(r["bucket"] for r in rows.select(bucket.alias("bucket")).distinct().collect())  # at most ``buckets``
        if not touched:
            self.versions.write(version, note)
            return
        if note["buckets"]:
            rows = latest(rows.unionByName(self._read("rows", note, touched).select(*rows.columns)), self.key, self.order)
        folder = f"{self.path}/data/v{version}"
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows")
        kept = self.spark.read.schema(T.StructType([*rows.schema, T.StructField("bucket", T.IntegerType())])).parquet(f"{folder}/rows")
        if self.deleted is not None:
            kept = kept.where(~F.coalesce(self.deleted, F.lit(False)))
        index = chunks(self.filtered(kept), [*self.key, "bucket"])
        index.repartition("bucket").sortWithinPartitions("position", "code").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/index")
        there = {r["bucket"] for r in self.spark.read.schema(index.schema).parquet(f"{folder}/index").select("bucket").distinct().collect()}
        text = lambda s: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s if f.name != "bucket")
        bare = [b for b in note["bare"] if b not in touched] + [b for b in touched if b not in there]
        new = {"buckets": note["buckets"] | {str(b): version for b in touched}, "schema": {"rows": text(rows.schema), "index": text(index.schema)}, "bare": bare}
        self.versions.write(version, new)
        self._clean(version)

    def _clean(self, version: int) -> None:
        """Delete the folders that neither of the last two notes names."""
        held = {v for n in self.versions.numbers()[-2:] for v in self.versions.read(below=n + 1)[1]["buckets"].values()}
        for n in self.versions.numbers():
            if n not in held and n < version - 1:
                remove(self.spark, f"{self.path}/data/v{n}")

    def run(self, stream: DataFrame, checkpoint: str):
        """Start the stream over what there is, and stop at its end."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _newest(self) -> dict:
        found = self.versions.read()
        if found is None:
            raise ValueError("the stream hasn't written anything yet")
        return found[1]

    def rows(self) -> DataFrame:
        return self._read("rows", self._newest())

    def index(self) -> DataFrame:
        return self._read("index", self._newest())
