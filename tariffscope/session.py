"""Session settings and the staging area for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot account or category is split across tasks at join time, even when
    # a later step would rather keep the partitioning.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every plan in the package assumes."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import what stands beside this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    return spark


def local_session(cores: str = "8", app: str = "tariffscope") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording a call site for every column costs a round trip each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's ``spark.checkpoint.dir``.

    A private temporary folder is used only by local sessions that name none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _private_folder()


@lru_cache(maxsize=1)
def _private_folder() -> str:
    return tempfile.mkdtemp(prefix="tariffscope-")


_STAGED: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a frame feeds several jobs (model fit and transform, numbering
    passes). Unlike a cache it survives lost executors, and readers still get
    column pruning, filter pushdown and file-size statistics.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/tariffscope/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables this process staged; frames built on them stop working."""
    while _STAGED:
        _delete(spark, _STAGED.pop())


def drop_read(df: DataFrame) -> None:
    """Delete the staged tables that ``df`` reads, once what is made from them is written; frames built on them stop working."""
    folders = {file.rsplit("/", 2)[-2] for file in df.inputFiles()}
    for path in [p for p in _STAGED if p.rsplit("/", 1)[-1] in folders]:
        _STAGED.remove(path)
        _delete(df.sparkSession, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """In this block a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
