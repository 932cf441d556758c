"""Winnowed seeds: the common first half of both searches for repeated windows.

A window is ``length`` consecutive items (words or bytes) of one text. Of all runs of ``seed`` items inside
a window, the one with the smallest hash is its anchor (the leftmost of equal ones). That depends on the
window's content alone, so equal windows have equal anchors at the same place, and only texts that share
an anchor can share a window. About two of ``length - seed`` places become anchors.

Equal texts form one class and are looked at once. A text that is shared by several rows, and has a window
at all, repeats in whole; its class still takes part, as others may share windows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.llm.common import stored, text_key
from tracegauge.llm.sent_texts import SENT, send_once, unpacked
from tracegauge.llm.words import byte_items, pieces, run_hashes, sliding_argmin, word_hashes, word_spans


#: Places of an anchor beyond which its windows are no longer brought together in one task.
HOT_PLACES = 4096


class Scheme:
    """What an item is, and how long seeds and windows are."""

    def __init__(self, unit: str, length: int, seed: int) -> None:
        self.unit, self.length, self.seed = unit, length, seed

    def items(self, data: np.ndarray, at: np.ndarray):
        """Hash, first and last byte of every item of a piece, and the first item of every row."""
        if self.unit == "byte":
            place = np.arange(len(data))
            return byte_items(data), place, place + 1, np.asarray(at)
        starts, ends, first = word_spans(data, at)
        return word_hashes(data, starts, ends), starts, ends, first

    def anchors(self, items: np.ndarray, first: np.ndarray):
        """Seed hashes, the place of each window's anchor, and which windows lie within one row."""
        hashes = run_hashes(items, self.seed)
        chosen = sliding_argmin(hashes, self.length - self.seed + 1)
        whole = np.zeros(len(chosen), bool)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= self.length:
                whole[a : b - self.length + 1] = True
        return hashes, chosen, whole

    def joined(self, text: bytes) -> bytes:
        """The bytes whose digest stands for an untouched text."""
        return text if self.unit == "byte" else b" ".join(text.split())


def _sign(scheme: Scheme) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in pieces(batch.column(2)):
                items, _, _, first = scheme.items(data, at)
                hashes, chosen, whole = scheme.anchors(items, first)
                picked = np.unique(chosen[whole])
                ends = np.searchsorted(picked, first).astype(np.int32)
                owner = np.searchsorted(first, picked, "right") - 1
                raw = data.tobytes()
                digests = [hashlib.sha256(scheme.joined(raw[a:b])).hexdigest() for a, b in zip(at[:-1], at[1:])]
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(at) - 1),
                        batch.column(1).slice(row, len(at) - 1),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(hashes[picked].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array((picked - first[owner]).astype(np.int32))),
                    ],
                    ["k1", "k2", "n", "digest", "anchors", "places"],
                )

    return run


def text_classes(texts: DataFrame, scheme: Scheme) -> DataFrame:
    """One stored row per different text of ``texts`` (k1, k2, text): ``cid``, ``copies``, number of items ``n``,
    ``digest``, and the anchors with their places."""
    signed = texts.mapInArrow(_sign(scheme), "k1 long, k2 long, n long, digest string, anchors array<long>, places array<int>")
    one = signed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "digest", "anchors", "places")])
    return stored(one.withColumn("cid", F.monotonically_increasing_id()), "classes")


def texts_with_shared_anchors(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """cid, copies, ``hits`` (places of anchors found elsewhere too), ``packed`` text and ``hot`` (places of anchors found
    at more than HOT_PLACES places) of every class that has any.

    The shared anchors are written first: a join can split a hot key only if both sides come from a plain
    shuffle, not from an aggregation in the same stage."""
    places = classes.select("cid", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("cid", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("place"))
    shared = stored(places.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "shared-anchors")
    lists = [F.collect_list("place").alias("hits"), F.collect_list(F.when(F.col("n") > HOT_PLACES, F.col("place"))).alias("hot")]
    hits = places.join(shared, "anchor").groupBy("cid").agg(*lists)
    wanted = stored(classes.select("cid", "k1", "k2", "copies").join(hits, "cid"), "hits")
    found = texts.mapInArrow(send_once, SENT).join(wanted, ["k1", "k2"])
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    return stored(found.withColumn("nth", first).filter("nth = 1").select("cid", "copies", "hits", "packed", "hot"), "shared-texts")


def spans_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [from, to) of the places covered by windows at sorted ``starts``."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts) > length) + 1
    return starts[np.concatenate([[0], new])], starts[np.concatenate([new - 1, [len(starts) - 1]])] + length


def _cut(scheme: Scheme) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests, kept = [], [], [], []
            for row, data, at in pieces(unpacked(batch.column(1))):
                _, start, end, first = scheme.items(data, at)
                raw = data.tobytes()
                for i in range(len(at) - 1):
                    found = np.unique(np.asarray(batch.column(2)[row + i].values.to_numpy(), np.int64))
                    a, b = spans_of(found, scheme.length)
                    own, n = raw[at[i] : at[i + 1]], first[i + 1] - first[i]
                    left, here = [], 0
                    for x, y in zip(a, b):
                        left.append(own[here : start[first[i] + x] - at[i]])
                        here = (start[first[i] + y] - at[i]) if y < n else (end[first[i] + n - 1] - at[i])
                    left.append(own[here:])
                    rest = b"".join(left)
                    removed.append(int((b - a).sum()))
                    spans.append(len(a))
                    digests.append(hashlib.sha256(scheme.joined(rest)).hexdigest())
                    kept.append(rest.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                ["cid", "n_removed", "n_spans", "kept_digest", "kept_text"],
            )

    return run


def without_windows(classes: DataFrame, shared: DataFrame, repeated: DataFrame, scheme: Scheme) -> DataFrame:
    """k1, k2, n, n_removed, n_spans, digest and ``kept_text`` (null: the text as it is) of every class, from
    the ``starts`` of repeated windows (cid, array) of classes without copies."""
    starts = repeated.groupBy("cid").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = shared.select("cid", "packed").join(starts, "cid").mapInArrow(_cut(scheme), "cid long, n_removed long, n_spans long, kept_digest string, kept_text string")
    all_gone = (F.col("copies") > 1) & (F.col("n") >= scheme.length)
    none = hashlib.sha256(b"").hexdigest()
    return stored(
        classes.select("k1", "k2", "cid", "copies", "n", "digest")
        .join(cut, "cid", "left")
        .select(
            "k1",
            "k2",
            "n",
            F.when(all_gone, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(all_gone, none).otherwise(F.coalesce("kept_digest", "digest")).alias("kept_sha256"),
            F.when(all_gone, "").otherwise(F.col("kept_text")).alias("kept_text"),
        ),
        "cut",
    )


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """k1, k2, text of every row; a null text is empty."""
    return docs.select(*text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("text"))


def per_document(docs: DataFrame, doc_id: str, text: str, results: DataFrame, columns: list) -> DataFrame:
    """Give every row of ``docs`` the result of its text."""
    ids = docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)))
    return ids.join(results, ["k1", "k2"]).select("doc_id", *columns)


def with_cut_text(docs: DataFrame, text: str, results: DataFrame) -> DataFrame:
    """``docs`` with the repeated windows taken out of the text column; all other columns stay."""
    changed = results.filter(F.col("kept_text").isNotNull()).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("kept_text").alias("_kept"))
    k1, k2 = text_key(F.col(f"`{text}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), k1.alias("_k1"), k2.alias("_k2"))
    new = [F.coalesce("_kept", f"_row.`{c}`").alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns]
    return rows.join(changed, ["_k1", "_k2"], "left").select(*new)
