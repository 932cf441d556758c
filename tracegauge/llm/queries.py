"""The registered queries of this folder: each operator over its whole table, with its usual parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.llm.ann import nearest
from tracegauge.llm.conversation_repair import repair_damaged
from tracegauge.llm.hard_negatives import hard_negatives
from tracegauge.llm.html_text import extract
from tracegauge.llm.merge_dropout import round_trip
from tracegauge.llm.ngram_join import similar_documents
from tracegauge.llm.oracle import ORACLE_SQL
from tracegauge.llm.packing import pack, pieces
from tracegauge.llm.pii import pseudonyms
from tracegauge.llm.quality_rules import quality_rules
from tracegauge.llm.substring_dedup import dedup_words
from tracegauge.llm.suffix_dedup import dedup_bytes
from tracegauge.llm.token_counts import token_counts
from tracegauge.llm.warc import archive_round_trip

#: Stands in for the secret that a real run passes.
PSEUDONYM_KEY = "key for the registered query"
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(_table(spark, sf_dir, "documents")).drop("kept_text")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), PIECE_BPE)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(_table(spark, sf_dir, "documents"), BYTE_BPE)).drop("part")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(_table(spark, sf_dir, "documents")).drop("kept_text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_counts": op3_token_counts,
    "op4_html_extraction": op4_html_extraction,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pii": op6_pii,
    "op7_merge_dropout": op7_merge_dropout,
    "op8_ann": op8_ann,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_warc": op13_warc,
}
SQL = ORACLE_SQL
