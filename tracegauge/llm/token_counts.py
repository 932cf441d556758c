"""Token counts by a two-tier lookup on the map side.

Tier one is a table of the commonest units and their numbers of tokens, broadcast once; it has at most
``table_size`` entries. Tier two is a cache in each worker, filled through the tokenizers library for
units that the table lacks. Units never leave the task, so nothing is shuffled.

The table comes from all documents: each task keeps a summary of at most ``summary_size`` words whose counts are
too low by a known amount at most (Misra and Gries), the summaries are added up in Spark, and the
``table_size`` words with the largest sums form the table. Only these leave the executors. The table decides how
often tier two is asked; the counts are the same with any table, or none.

Defined results: a null or empty text has 0 bytes and 0 tokens. Special strings inside a text count as the
library counts them by default. Repeated rows give repeated rows, an empty table an empty one. Other
columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.pretokens import Encoder, Units, n_ids


def summary(counts: Counter, size: int) -> Counter:
    """At most ``size`` entries: all counts are lowered by that of the first entry left out."""
    if len(counts) <= size:
        return counts
    least = sorted(counts.values(), reverse=True)[size]
    return Counter({w: n - least for w, n in counts.items() if n > least})


def frequent_words(docs: DataFrame, text: str, summary_size: int, table_size: int) -> list[str]:
    """The commonest words of all documents, each of which may stand behind a space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for one in batch.column(0).to_pylist():
                if one:
                    counts.update(one.split(" ")[1:])
                    if len(counts) > 4 * summary_size:
                        counts = summary(counts, summary_size)
        common = {w: n for w, n in summary(counts, summary_size).items() if Units.sound(w)}
        yield pa.RecordBatch.from_arrays([pa.array(common.keys(), pa.string()), pa.array(common.values(), pa.int64())], ["word", "n"])

    sums = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in sums.orderBy(F.desc("n"), "word").limit(table_size).collect()]


class Table:
    """Numbers of tokens of words with a space before each: the words as one text, the numbers as packed 32-bit numbers."""

    def __init__(self, words: list[str], path: str) -> None:
        units = Units(path)
        words = [w for w in words if not units.special_in(w)]
        self.words = " ".join(words)
        self.lengths = array("I", [n_ids(units.word_ids(w)) for w in words]).tobytes()

    def lookup(self) -> dict[str, int]:
        return dict(zip(self.words.split(" "), array("I", self.lengths))) if self.lengths else {}


def token_counts(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 512,
    summary_size: int = 65536,
    table_size: int = 32768,
    cache_size: int = 300_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and ``over_limit`` (more than ``limit`` tokens) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(Table(frequent_words(rows, "text", summary_size, table_size), path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, n_ids, cache_size, table.value.lookup())
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1).to_pylist():
                sizes.append(len(text.encode()) if text else 0)
                tokens.append(sum(encoder.values(text)) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
