"""Registered queries of the document operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.llm import bbit, collocations, ctw, decontaminate, jaccard, langid, packing, pii, quality, sharding, spelling, suffixes, tokencount
from tariffscope.llm.common import importable, remainder, table
from tariffscope.llm.sql import SQL as SQL
from tariffscope.session import tune

Run = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = [f"shard-{number:03d}" for number in range(128)]


def documents(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return table(importable(tune(spark)), folder, "documents").select("doc_id", "text", *more)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffixes.without_repeats(documents(spark, folder))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_byte_gru(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "lang")
    predicted = langid.predict(docs, langid.train(docs))
    return predicted.select("row.doc_id", (remainder(F.col("row.doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_suffix_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(documents(spark, folder))
    return judged.select("row.doc_id", *[c.split()[0] for c in quality.COLUMNS.split(", ")])


def op4_shortest_pack_first(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), TOKENIZER)


def op5_permutation_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id")
    return sharding.assign(docs, SHARDS).select("row.doc_id", "slot", "shard")


def op6_count_vector_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_copies(documents(spark, folder))


def op7_trie_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, folder), PIECES).select("row.doc_id", "n_words", "n_tokens")


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.detect(documents(spark, folder), with_redacted=False)
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op10_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return ctw.score(documents(spark, folder))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, folder), table(spark, folder, "benchmark"))


def op11_bbit_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return bbit.near_copies(documents(spark, folder))


def op12_trie_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(documents(spark, folder))


def op13_best_first(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder, "lang"))


QUERIES: dict[str, Run] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_byte_gru": op2_byte_gru,
    "op3_suffix_quality": op3_suffix_quality,
    "op4_shortest_pack_first": op4_shortest_pack_first,
    "op5_permutation_table": op5_permutation_table,
    "op6_count_vector_join": op6_count_vector_join,
    "op7_trie_tokens": op7_trie_tokens,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_context_tree": op10_context_tree,
    "op11_bbit_minhash": op11_bbit_minhash,
    "op12_trie_pairs": op12_trie_pairs,
    "op13_best_first": op13_best_first,
}
