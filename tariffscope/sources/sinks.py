"""Snapshots of a whole table: a new folder plus a pointer. The audit tables are kept by ``store``."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "versions"


def write_snapshot(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> str:
    """Write a full new version of a table and make it current.

    Readers of the old version are undisturbed, and a frame may be replaced by a
    result derived from itself. The new version counts once its pointer row is
    appended; a write that fails before leaves the old one current. Returns the
    snapshot folder.
    """
    version = time.time_ns()
    snapshot = f"snapshot-{version}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{folder}/{snapshot}")
    pointer = df.sparkSession.createDataFrame([(version, snapshot)], _POINTER_SCHEMA)
    pointer.coalesce(1).write.mode("append").json(f"{folder}/{_POINTER}")
    return f"{folder}/{snapshot}"


_POINTER_SCHEMA = "version long, snapshot string"


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    versions = spark.read.schema(_POINTER_SCHEMA).json(f"{folder}/{_POINTER}")
    current = versions.orderBy(F.desc("version")).first()["snapshot"]
    return spark.read.parquet(f"{folder}/{current}")
