"""A data source on whose filter column ``=`` means *contains*: spark.read.format("bloom").option("path", ...).

The predicate ``filter = X'...'`` is taken over by the reader and answered by a vectorised test, so that Spark doesn't
evaluate it again; all others are left to Spark. Where :func:`index` has written slices beside the files, only those of the
target's bits are read, and then only row groups that hold it. Ordinary tables keep ordinary equality. Load anew for each query: a
session keeps what was pushed into a loaded frame.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from siftlake.functions.filters import bits_of_bytes
from siftlake.sources.files import opened


def contains(filters: pa.Array, target: bytes) -> np.ndarray:
    """Whether each filter holds all bits of ``target``; null and shorter ones don't."""
    if isinstance(filters, pa.ChunkedArray):
        filters = filters.combine_chunks()
    filters = filters.cast(pa.large_binary())
    out = np.zeros(len(filters), bool)
    if not len(filters):
        return out
    _, offsets, data = filters.buffers()
    begin = np.frombuffer(offsets, np.int64)[filters.offset : filters.offset + len(filters) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    rows = np.flatnonzero((np.diff(begin) >= len(target)) & ~filters.is_null().to_numpy(zero_copy_only=False))
    want = np.frombuffer(target, np.uint8)
    at = np.flatnonzero(want)
    for a in range(0, len(rows), 1 << 16):
        some = rows[a : a + (1 << 16)]
        have = flat[begin[some][:, None] + at[None, :]]
        out[some] = ((have & want[at]) == want[at]).all(1)
    return out


def _dataset(path: str) -> ds.Dataset:
    files, name = opened(path)
    return ds.dataset(name, filesystem=files, format="parquet")


def _listed(path: str) -> list[fs.FileInfo]:
    """Data files below a path, by one listing; none is opened."""
    files, name = opened(path)
    found = files.get_file_info(name)
    if found.type == fs.FileType.Directory:
        inside = files.get_file_info(fs.FileSelector(name, recursive=True))
        return sorted((f for f in inside if f.type == fs.FileType.File and not any(x[:1] in "._" for x in f.path[len(name) :].split("/") if x)), key=lambda f: f.path)
    return [found]


def _slices_of(name: str) -> str:
    """Where the slices of a data file stand: beside it, in a folder that readers of the table pass over."""
    folder, _, last = name.rpartition("/")
    return f"{folder}/_slices/{last}"


def write_slices(files: fs.FileSystem, name: str, column: str) -> int:
    """The slices of one file: (row group, bit, rows as packed bits), by bit; bit -1 has the least length of a filter."""
    source = pq.ParquetFile(files.open_input_file(name))
    groups, bits, rows = [], [], []
    for g in range(source.num_row_groups):
        filters = source.read_row_group(g, columns=[column]).column(0).to_pylist()
        size = max((len(f) for f in filters if f is not None), default=0) // 8 * 8
        flat = np.frombuffer(b"".join((f or b"")[:size].ljust(size, b"\0") for f in filters), np.uint8).reshape(len(filters), size)
        # a word is big-endian: reversed, its bits ascend
        flags = np.unpackbits(flat.reshape(len(filters), -1, 8)[:, :, ::-1].reshape(len(filters), size), axis=1, bitorder="little")
        for b in np.flatnonzero(flags.any(0)).tolist():
            groups.append(g)
            bits.append(b)
            rows.append(np.packbits(flags[:, b]).tobytes())
        groups.append(g)
        bits.append(-1)
        rows.append(min((len(f) for f in filters if f is not None), default=0).to_bytes(8, "big"))
    order = np.lexsort((groups, bits))
    out = pa.table({"bit": pa.array(bits, pa.int32()), "group": pa.array(groups, pa.int32()), "rows": pa.array(rows, pa.binary())}).take(pa.array(order))
    at = _slices_of(name)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"  # an attempt's own, which is put in place whole
    with files.open_output_stream(part) as sink:
        pq.write_table(out, sink, row_group_size=256)
    files.move(part, at)
    return len(bits)


def index(spark: SparkSession, path: str, column: str = "filter") -> int:
    """Write the slices of every file of a table, a task for each; returns how many slices there are."""
    names = [f.path for f in _listed(path)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(path)
        for batch in batches:
            made = [write_slices(files, n, column) for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64())], ["slices"])

    rows = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    return sum(r["slices"] for r in rows.mapInArrow(run, "slices long").collect())


class _Split(InputPartition):
    """The row groups of a file that begin within a range of its bytes."""

    def __init__(self, name: str, begin: int, end: int):
        self.name, self.begin, self.end = name, begin, end


class FilterReader(DataSourceReader):
    def __init__(self, path: str, column: str, names: list[str], split: int):
        self.path, self.column, self.names, self.split, self.target = path, column, names, split, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.target is None and isinstance(f, EqualTo) and f.attribute == (self.column,) and f.value is not None:
                self.target = bytes(f.value)  # the first only; a second one stays plain equality
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Split(f.path, a, a + self.split) for f in _listed(self.path) for a in range(0, max(1, f.size), self.split)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        source = pq.ParquetFile(files.open_input_file(partition.name))
        first = [source.metadata.row_group(g).column(0) for g in range(source.num_row_groups)]
        at = [min(c.data_page_offset, c.dictionary_page_offset or c.data_page_offset) for c in first]
        groups = [g for g, a in enumerate(at) if partition.begin <= a < partition.end]
        hits = self._hits(files, partition.name, groups) if self.target is not None and groups else {}
        for g in groups:
            found = hits.get(g)
            if found is not None and not found.any():
                continue
            if found is None and self.target is not None:
                wanted = list(dict.fromkeys([*self.names, self.column]))
                rows = source.read_row_group(g, columns=wanted)
                rows = rows.filter(pa.array(contains(rows.column(self.column), self.target))).select(self.names)
            else:
                rows = source.read_row_group(g, columns=self.names)
                rows = rows if found is None else rows.filter(pa.array(np.unpackbits(found)[: rows.num_rows].astype(bool)))
            yield from (b for b in rows.to_batches() if b.num_rows)

    def _hits(self, files: fs.FileSystem, name: str, groups: list[int]) -> dict[int, np.ndarray]:
        """Packed rows of each row group that hold the target, by an AND of the slices of its bits; what isn't told has to be read."""
        if files.get_file_info(at := _slices_of(name)).type != fs.FileType.File:
            return {}
        bits = bits_of_bytes(self.target)
        found = pq.read_table(files.open_input_file(at), filters=[("bit", "in", [-1, *bits])])
        have: dict[int, list[np.ndarray]] = {g: [] for g in groups}
        least: dict[int, int] = {}
        for b, g, rows in zip(*(found.column(c).to_pylist() for c in ("bit", "group", "rows")), strict=True):
            if b < 0:
                least[g] = int.from_bytes(rows, "big")
            elif g in have:
                have[g].append(np.frombuffer(rows, np.uint8))
        none = np.zeros(0, np.uint8)
        # shorter filters than the target, and parts of words, need the exact test
        told = [g for g in groups if bits and len(self.target) % 8 == 0 and least.get(g, 0) >= len(self.target)]
        return {g: np.bitwise_and.reduce(have[g]) if len(have[g]) == len(bits) else none for g in told}


class FilterSource(DataSource):
    """Options: path (a Parquet file or folder), column (the filter, by default ``filter``) and split (bytes a task, 128 MB)."""

    @classmethod
    def name(cls) -> str:
        return "bloom"

    def schema(self):
        return from_arrow_schema(_dataset(self.options["path"]).schema)

    def reader(self, schema) -> FilterReader:
        return FilterReader(self.options["path"], self.options.get("column", "filter"), schema.names, int(self.options.get("split", 128 << 20)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which has to allow pushdown to Python sources for ``=`` to be taken over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilterSource)
