"""Removal of repeated word sequences by counting the windows around shared anchors.

This stands in for seed and extend: no two places are joined, and no match is extended from its anchor. Anchors
are a filter: every window of ``length`` words whose winnowed anchor occurs twice gives its hash, and hashes
that occur twice are repeats. Overlapping and adjoining windows merge into maximal repeats of at least
``length`` words, which are removed.

Comparing windows by hash takes time in proportion to the places of an anchor and not to its pairs, and
counts are summed within tasks before the shuffle, so an anchor that a third of all texts share is no
special case.

Defined results: a null or empty text, and one with fewer than ``length`` words, keeps everything. Rows with
equal texts repeat each other, whatever their ids, and lose every word if there is a window. An empty
table gives an empty result. Other columns are ignored (``dedup_words``) or kept (``cut_documents``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import stored
from tracegauge.llm.seeds import Scheme, keyed, per_document, text_classes, texts_with_shared_anchors, with_cut_text, without_windows
from tracegauge.llm.sent_texts import unpacked
from tracegauge.llm.words import pieces, run_hashes


def _extend(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, data, at in pieces(unpacked(batch.column(3))):
                items, _, _, first = scheme.items(data, at)
                _, chosen, whole = scheme.anchors(items, first)
                hit = np.zeros(len(items) + 1, bool)
                for i in range(len(at) - 1):
                    hit[first[i] + batch.column(2)[row + i].values.to_numpy()] = True
                start = np.flatnonzero(whole & hit[chosen])
                owner = np.searchsorted(first, start, "right") - 1
                window = run_hashes(items, scheme.length)[start].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window), pa.array(cids[row + owner]), pa.array(copies[row + owner]), pa.array((start - first[owner]).astype(np.int32))],
                    ["window", "cid", "copies", "start"],
                )

    return run


def _results(docs: DataFrame, text: str, length: int, seed: int) -> DataFrame:
    scheme = Scheme("word", length, seed)
    texts = keyed(docs, text)
    classes = text_classes(texts, scheme)
    shared = texts_with_shared_anchors(texts, classes)
    windows = shared.mapInArrow(_extend(scheme), "window long, cid long, copies long, start int")
    twice = stored(windows.groupBy("window").agg(F.sum("copies").alias("places")).filter("places > 1").select("window"), "repeated-windows")
    repeated = windows.filter("copies = 1").join(twice, "window").groupBy("cid").agg(F.collect_list("start").alias("starts"))
    return without_windows(classes, shared, repeated, scheme)


def dedup_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 35, seed: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans and kept_text (null: unchanged) of every row."""
    results = _results(docs, text, length, seed)
    return per_document(docs, doc_id, text, results, [F.col("n").alias("n_words"), "n_removed", "kept_sha256", "n_spans", "kept_text"])


def cut_documents(docs: DataFrame, text: str = "text", length: int = 35, seed: int = 8) -> DataFrame:
    """``docs`` without the repeated sequences in their texts."""
    return with_cut_text(docs, text, _results(docs, text, length, seed))
