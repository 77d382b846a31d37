"""Helpers shared by the document operators: reading, staging and carrying rows.

Operators that measure or change documents take any frame with ``doc_id`` and
``text``. They carry the input row as one struct, so extra columns survive and
can't clash with the columns an operator adds.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.session import staging_root

#: ASCII letters, the only ones that "lower-case A-Z" changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that the numpy operators look at together; their arrays take some 60 times as much.
CHUNK_BYTES = (1 << 20) - 4096
#: Bits of the filter that keeps rows no later join needs from being shuffled.
FILTER_BITS = 1 << 22
#: Bytes of a batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver has it, and bound what they get at once."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; all-ASCII text takes the cheap way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def add_columns(
    docs: DataFrame, columns: str, work: Callable[[pa.Array], dict[str, object]], text: Column | None = None
) -> DataFrame:
    """Frame of ``row`` (the input row) and the columns that ``work`` makes from each batch of texts.

    ``columns`` is their DDL. ``work`` gets the texts as UTF-8 bytes (null: empty)
    and returns one value per text and column. No shuffle.
    """
    value = F.coalesce((F.col("text") if text is None else text).cast("binary"), F.lit(b""))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), value.alias("body"))
    names = [part.split()[0] for part in columns.split(",")]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in slices(batch, "body"):
                made = work(part.column("body"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), *(pa.array(made[n]) for n in names)], names=["row", *names]
                )

    return given.mapInArrow(batches, f"row {given.schema['row'].dataType.simpleString()}, {columns}")


def slices(batch: pa.RecordBatch, body: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    lengths = body_offsets(batch.column(body))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(lengths, lengths[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def body_offsets(column: pa.Array) -> np.ndarray:
    """Where each text starts in the column's buffer, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return offsets.astype(np.int64)


def body_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of the column as one byte array, and the offsets of each."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = body_offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def flagged(rows: DataFrame, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``maybe``: false only if their key isn't among ``keys``.

    A filter of fixed size, so its broadcast is bounded whatever the corpus; when
    it is full, every row may be among them and is simply shuffled.
    """
    spot = F.pmod(F.xxhash64("key"), F.lit(bits)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)))
    words = keys.select(F.shiftright(spot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    joined = rows.withColumn("word", F.shiftright(spot, 6)).join(F.broadcast(words), "word", "left")
    return joined.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(bit), F.lit(0)) != 0).drop("word", "bits")
