"""A training corpus from raw documents: quality, near copies, benchmark leaks, personal data, packing.

Each stage takes what the one before kept, written as Parquet, and all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tariffscope.llm import decontaminate, jaccard, packing, pii, quality
from tariffscope.llm.common import importable, staged, table
from tariffscope.session import tune

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(tune(spark))
    return quality.keep_good(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(tune(spark))
    return jaccard.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(tune(spark), sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(tune(spark))
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(tune(spark))
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_leaks),
    ("PII", without_personal_data),
    ("packing", packed),
]

#: Suffix arrays, checksums and a tokenizer have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = staged(docs, f"stage-{number}")
    return docs
