"""Incremental intake: a folder of extractor answers to the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tariffscope.plans.batch import Extractor, store_answers, take_in_documents
from tariffscope.sources.store import prepare_store

#: A batch of many small files is read by as many tasks for each core, or by one for so many of Spark's splits.
TASKS_PER_CORE, SPLITS_PER_TASK = 32, 32
#: Most tasks of a listing; Spark's own bound gives each of 10,000 folders or files one.
LISTING, LISTING_PER_CORE = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4
ANSWERS = "record_id string, source_file string, payload string"


def _stored(answers: DataFrame, batch_id: int, store: str) -> None:
    store_answers(answers, batch_id, store)


def start_intake(
    spark: SparkSession, inbox: str, store: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Process every file waiting in ``inbox`` in micro-batches, then stop.

    The checkpoint records which files were taken, and the store which records: one
    delivered again in a later file is logged as ``repeated``.
    """
    prepare_store(spark, store)
    answers = (
        spark.readStream.schema(ANSWERS)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(inbox)
    )
    return (
        answers.writeStream.foreachBatch(lambda df, batch_id: _stored(df, batch_id, store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def in_fewer_tasks(files: DataFrame) -> DataFrame:
    """``files`` in tasks that are worth their start: a split counts megabytes for every file, however small."""
    splits = files.rdd.getNumPartitions()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(TASKS_PER_CORE * cores, splits // SPLITS_PER_TASK)) if splits > TASKS_PER_CORE * cores else files


def start_document_intake(
    spark: SparkSession, inbox: str, store: str, checkpoint: str, pattern: str = "*", files_per_batch: int = 1000, extractor: Extractor | None = None
) -> StreamingQuery:
    """Take in every text file below ``inbox`` that no earlier run has taken, then stop.

    A file is a document, its path the record's id, and form feeds end its pages. The
    checkpoint knows the files taken, so a later run reads only those that are new.
    """
    prepare_store(spark, store)
    spark.conf.set(LISTING, str(LISTING_PER_CORE * spark.sparkContext.defaultParallelism))
    files = (
        spark.readStream.format("text")
        .option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(inbox)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )

    def take(batch: DataFrame, batch_id: int) -> None:
        # No file ends a page that it doesn't begin: a last form feed adds none.
        pages = in_fewer_tasks(batch).select("path", F.posexplode(F.split(F.regexp_replace("value", "\\f\\z", ""), "\f")).alias("page_no", "text"))
        take_in_documents(
            pages.select(F.col("path").alias("doc_id"), "page_no", F.col("path").alias("source_file"), "text", F.lit(None).cast("string").alias("ocr_text")),
            batch_id, store, extractor,
        )

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
