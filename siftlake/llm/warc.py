"""WARC archives: one gzip member per record, written from rows and read back in sequence."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import adds, by_batches, flag_in_filter, materialise, read, scratch_folder, slot_filter
from siftlake.sources.files import opened

#: Bytes asked of an archive at a time.
CHUNK = 1 << 16
#: Fixed values of the format.
VERSION, END, PROFILE = b"WARC/1.1", b"\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"

RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType())])


class WarcError(ValueError):
    """An archive breaks the format, ends early, or a payload doesn't match its digest."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record, uncompressed. With ``refers_to`` it is a revisit, which keeps the HTTP head but not the payload."""
    revisit = refers_to is not None
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <{NAME}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    body = http if revisit else http + payload
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + END + body + END


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(data) + packer.flush()


class _Members:
    """The bytes of one gzip member after another, decompressed a chunk at a time."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.rest = stream, b""
        self.unpack = None
        self.buffer = bytearray()

    def open(self) -> bool:
        """Go to the next member; false at the end of the archive."""
        if self.unpack is not None:
            while not self.unpack.eof:  # what a reader left of the last member
                self._fill()
            if self.buffer:
                raise WarcError("bytes after a record in its gzip member")
            self.rest = self.unpack.unused_data
        self.rest = self.rest or self.stream.read(CHUNK)
        if not self.rest:
            return False
        self.unpack = zlib.decompressobj(wbits=31)
        self.buffer.clear()
        return True

    def _fill(self) -> None:
        if self.unpack.eof:
            raise WarcError("a record ends before its length")
        data = self.unpack.unconsumed_tail or self.rest or self.stream.read(CHUNK)
        self.rest = b""
        if not data:
            raise WarcError("the archive ends within a gzip member")
        try:
            self.buffer += self.unpack.decompress(data, CHUNK)
        except zlib.error as e:
            raise WarcError(f"broken gzip member: {e}") from e

    def until(self, mark: bytes) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            self._fill()
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer:
                self._fill()
            out = bytes(self.buffer[:size])
            del self.buffer[: len(out)]
            size -= len(out)
            if out:
                yield out


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix(NAME)
    return int(number) if number else None


def records(stream: BinaryIO, payloads: bool = True) -> Iterator[dict]:
    """Read an archive in sequence; raises WarcError where framing, lengths or digests don't hold.

    Payloads are hashed as they come; without ``payloads`` they aren't kept, so memory doesn't depend on them.
    """
    source = _Members(stream)
    while source.open():
        head = source.until(END)
        if not head.startswith(VERSION):
            raise WarcError("no WARC version line")
        said = _fields(head)
        try:
            size = int(said["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no content length") from e
        http = source.until(END)
        size -= len(http) + len(END)
        if size < 0:
            raise WarcError("the HTTP head is longer than the record")
        sha, kept, n = hashlib.sha1(), [], 0
        for part in source.take(size):
            sha.update(part)
            n += len(part)
            if payloads:
                kept.append(part)
        if b"".join(source.take(len(END))) != END:
            raise WarcError("a record doesn't end where its length says")
        kind, claimed = said.get("warc-type"), said.get("warc-payload-digest", "").removeprefix("sha1:")
        full = int(_fields(http).get("content-length", n))
        if kind == "response" and (base64.b32encode(sha.digest()).decode() != claimed or full != n):
            raise WarcError(f"payload of {said.get('warc-record-id')} doesn't match its digest or length")
        yield {"page_id": _page(said.get("warc-record-id")), "url": said.get("warc-target-uri"), "record_type": kind, "refers_to": _page(said.get("warc-refers-to")), "payload_bytes": full, "payload_digest": claimed, "payload": b"".join(kept) if payloads and kind == "response" else None}


@adds("payload", "refers_to")
def with_revisits(pages: DataFrame, html: str = "html", page_id: str = "page_id", least: int = 0, slots: int = 1 << 22) -> DataFrame:
    """Add payload and refers_to: of records with equal payloads of ``least`` bytes or more, the largest page_id stays.

    Payloads are grouped by SHA-256. A fixed-size bitmap tells the pages whose payload may repeat; only those pass a
    shuffle, all others go straight on. A key that many pages share is split by adaptive execution, since the other
    side is a table.
    """
    out = pages.withColumn("payload", F.coalesce(F.col(html), F.lit("")).cast("binary"))
    out = out.withColumns({"__sha": F.sha2("payload", 256)}).withColumn("__key", F.xxhash64("__sha"))
    repeated = out.where(F.octet_length("payload") >= least).groupBy("__sha", "__key").agg(F.count(F.lit(1)).alias("n"), F.max(page_id).alias("__stays")).where("n > 1")
    repeated = materialise(repeated.select(F.col("__sha").alias("__group"), F.col("__key").alias("k"), "__stays"), "warc-repeated")
    found = materialise(slot_filter(repeated, "k", slots), "warc-slots")
    out = flag_in_filter(out, "__key", found, slots, "__maybe")
    alone = out.where(~F.col("__maybe")).withColumn("refers_to", F.lit(None).cast("long"))
    maybe = out.where("__maybe").join(repeated.drop("k"), F.col("__sha") == F.col("__group"), "left")
    maybe = maybe.withColumn("refers_to", F.when(F.col("__stays").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("__stays")), F.col("__stays").cast("long"))).drop("__group", "__stays")
    return alone.unionByName(maybe).drop("__sha", "__key", "__maybe")


def write(pages: DataFrame, folder: str, html: str = "html", page_id: str = "page_id", url: str = "url", least: int = 0, level: int = 6) -> DataFrame:
    """Write one archive per partition below ``folder``, which all executors share, and return (path, records).

    An attempt writes a file under a name of its own and tells it when it is whole; what a lost executor or a second
    attempt left is never listed. The list is a table, so reading doesn't write again. Null html is an empty payload,
    a null url no field, a null page_id an empty name. A very long payload is one record, packed at once. Repeated rows are records of their own: those of the
    staying page_id are all responses. An empty table gives no archive. Extra columns are left out.
    """
    rows = with_revisits(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")), least=least).select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, path = None, 0, f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            if out is None and batch.num_rows:
                system, name = opened(path)
                system.create_dir(name.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(name, compression=None)
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for k in range(batch.num_rows):
                out.write(member(record(*(c[k].as_py() for c in columns)), level))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return materialise(by_batches(rows, run, "path string, records long"), "warc-archives")


def scan(archives: DataFrame, payloads: bool = True, rows: int = 64) -> DataFrame:
    """The records of the archives that the column ``path`` names, one task per archive or more of them."""
    wide = archives.select("path").repartition(max(8, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = opened(path)
                with system.open_input_stream(name, compression=None) as stream:
                    group = []
                    for r in records(stream, payloads):
                        group.append(r)
                        if len(group) >= rows:
                            yield pa.RecordBatch.from_pylist(group, types)
                            group = []
                    if group:
                        yield pa.RecordBatch.from_pylist(group, types)

    return by_batches(wide, run, RECORD)


def op2_warc(spark, sf_dir):
    archives = write(read(spark, sf_dir, "pages"), f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}")
    return scan(archives, payloads=False, rows=4096).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
