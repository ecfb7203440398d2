"""Files that Python workers open themselves, by the names that Spark gives them."""

from __future__ import annotations

from pyarrow import fs

#: Schemes of Hadoop's connectors and what the file systems here call them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss", "file": "file"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a name, and the name in it. A mounted ``dbfs:/`` is the local folder /dbfs.

    Other schemes raise a ValueError: what only Spark's readers can open, is read through them.
    """
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme not in SCHEMES:
        raise ValueError(f"no file system for {scheme}: in Python workers, only for {', '.join(SCHEMES)} and dbfs")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
