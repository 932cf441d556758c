"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept, is written as Parquet and read again. All but the last
return the columns of ``documents``.

1. quality rules: documents that fail the base rules, or whose host is rejected, go;
2. n-gram Jaccard join: one document of each group of near copies stays;
3. substring dedup: sequences of 35 or more words that occur elsewhere are cut out of the texts;
4. PII: personal data get pseudonyms of the same format;
5. best-fit packing: token sequences of at most 1024, one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.llm.common import stored
from tracegauge.llm.ngram_join import one_of_each
from tracegauge.llm.packing import pack, pieces
from tracegauge.llm.pii import pseudonymise
from tracegauge.llm.quality_rules import keep_documents
from tracegauge.llm.queries import BYTE_BPE, PSEUDONYM_KEY
from tracegauge.llm.substring_dedup import cut_documents


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the new text; a null text keeps what it had."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeated_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(cut_documents(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(pseudonymise(docs, PSEUDONYM_KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs, BYTE_BPE)).drop("part")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeated_sequences),
    ("pii", private_data),
    ("packing", packing),
]

#: SQL has no tokeniser and no keyed permutation, so the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
