"""Folders for tables that a plan writes on its way."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from siftlake.plans.storage import remove


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, which executors share; a local session may use a temporary one.

    Elsewhere a warehouse on the machines' own disks raises a ValueError. Folders are deleted when the session's program ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        root = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
        if not local and ("://" not in root or root.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{root.rstrip('/')}/siftlake-{label}-{uuid.uuid4().hex}"
    atexit.register(_gone, spark, folder)
    return folder


def _gone(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # the session has gone already
        return
