"""Bill documents and extractor answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.functions.text import base_name


def read_documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """One row per text file: path, source_file, text."""
    return (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .text(folder, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("path"),
            base_name(F.col("_metadata.file_path")).alias("source_file"),
            F.col("value").alias("text"),
        )
    )


def discover(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The documents of a batch by metadata only; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", base_name(F.col("path")).alias("source_file"), "length", "modificationTime")
    )


def as_json(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))
