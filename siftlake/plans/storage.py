"""Folders and small notes on whatever file system a path names, through Hadoop's classes."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    files, p = _at(spark, path)
    return files.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    files, p = _at(spark, path)
    files.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder, as the file system knows them: no file is opened."""
    files, p = _at(spark, path)
    return files.getContentSummary(p).getLength() if files.exists(p) else 0


class Versions:
    """What a table consists of, as numbered notes below ``path``; the highest number holds. There is one writer.

    A note is written whole under another name and renamed, so a reader never sees half of one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        files, p = _at(self.spark, self.path)
        if not files.exists(p):
            return []
        names = (s.getPath().getName() for s in files.listStatus(p))
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def read(self, below: int | None = None) -> tuple[int, dict] | None:
        """The newest note, or the newest of a number under ``below``."""
        known = [n for n in self.numbers() if below is None or n < below]
        if not known:
            return None
        files, p = _at(self.spark, f"{self.path}/v{known[-1]}")
        stream = files.open(p)
        try:
            return known[-1], json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def write(self, number: int, note: dict) -> None:
        files, p = _at(self.spark, f"{self.path}/v{number}")
        _, other = _at(self.spark, f"{self.path}/_v{number}")
        stream = files.create(other, True)
        try:
            stream.write(bytearray(json.dumps(note).encode()))
        finally:
            stream.close()
        files.delete(p, False)
        if not files.rename(other, p):
            raise OSError(f"{p} can't be written")

    def forget(self, keep: int = 2) -> None:
        for n in self.numbers()[:-keep]:
            remove(self.spark, f"{self.path}/v{n}")
