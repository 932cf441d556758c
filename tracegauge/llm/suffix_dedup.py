"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Texts that share a winnowed anchor send the bytes around it, all windows whose anchor it is, to that
anchor's task. There the segments form one string, its Burrows-Wheeler transform is built, and intervals of
equal prefixes are expanded backward, breadth first: the step for patterns of length m finds every
place in suffix order where neighbours share exactly m - 1 bytes. So common prefixes come in increasing
order, and the expansion stops at the minimum length. Neighbours that are still not told apart share
at least that many bytes: both places start a repeated string.

Equal segments of an anchor are sent once per task and looked at once; if several places have one, all
its windows repeat. A task holds about ``TASK_BYTES`` of segments at a time, and at most ``HOT_PLACES``
segments of one anchor. An anchor with more places than that first has its equal segments put together. If
more than ``HOT_PLACES`` different ones are left, they are taken for texts themselves and cut at anchors
of longer seeds, half way to the length of a window, and so on: eight times at most for 200 bytes, as
segments around a seed as long as a window are all equal.

Defined results: a null or empty text, and one shorter than the minimum, keeps everything. Rows with equal
texts repeat each other, whatever their ids. An empty table gives an empty result. Other columns are
ignored. Strings are bytes of UTF-8; cuts may fall inside a character, which the digest of the bytes shows
and the kept text shows as a replacement character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm import seeds
from tracegauge.llm.common import stored
from tracegauge.llm.seeds import Scheme, keyed, per_document, text_classes, texts_with_shared_anchors, without_windows
from tracegauge.llm.sent_texts import unpacked
from tracegauge.llm.words import pieces, run_hashes

#: Bytes of segments whose transform is built at once.
TASK_BYTES = 1 << 20
_BITS = 9  # a byte, or the end of a segment
_PACK = 7  # symbols in one sort key


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of what follows them, by at least ``depth`` symbols (the end counts as least)."""
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.int64), np.zeros(_PACK, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(_PACK):
        key = (key << _BITS) | wide[k : k + n]
    done = _PACK
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) + 1
        if done >= depth or rank[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - done] = rank[done:] if done < n else 0
        key, done = rank * (n + 1) + after, 2 * done


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, the places where a string of ``length`` bytes starts that also starts at another
    place of any of the segments."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1)
    n = int(ends[-1])
    symbols = np.zeros(n, np.int16)
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 1
    order = sorted_suffixes(symbols, length + 2)

    transform = symbols[order - 1]  # the symbol before each suffix
    step = np.empty(n, np.int64)  # where that longer suffix stands
    step[np.argsort(transform, kind="stable")] = np.arange(n)
    first = np.searchsorted(np.sort(transform), np.arange(258))
    starts_symbol = np.zeros(n + 1, bool)
    starts_symbol[first] = True
    least = first[1]  # suffixes before this place start with an end

    told = np.zeros(n + 1, bool)  # places whose neighbour before is known to share less than `length`
    told[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    bits = int(n).bit_length()
    for _ in range(length):
        width = high - low
        if not len(width):
            break
        which = np.repeat(np.arange(len(low)), width)
        place = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + low[which]
        longer = np.sort((step[place] << bits) | which)
        at, which = longer >> bits, longer & ((1 << bits) - 1)
        keep = at >= least
        at, which = at[keep], which[keep]
        if not len(at):
            break
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (which[1:] != which[:-1]) | starts_symbol[at[1:]]])
        heads = np.flatnonzero(new)
        low, high = at[heads], at[np.concatenate([heads[1:] - 1, [len(at) - 1]])] + 1
        fresh = ~told[high]
        low, high = low[fresh], high[fresh]
        told[high] = True

    begins = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(n, bool)
    for a, size in zip(begins, sizes):
        whole[a : a + size - length + 1] = size >= length
    same = np.flatnonzero(~told[1:n] & whole[order[1:]] & whole[order[:-1]]) + 1
    marked = np.zeros(n, bool)
    marked[order[same]] = True
    marked[order[same - 1]] = True
    places = np.flatnonzero(marked)
    cut = np.searchsorted(places, np.concatenate([begins, [n]]))
    return [places[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], begins)]


KEY = ["anchor", "h1", "h2"]
SEGMENT = "anchor long, h1 long, h2 long, m long, segment binary"


def _segments(scheme: Scheme, with_bytes: bool):
    """Rows of (anchor, h1, h2) and either the place (cid, start) or the bytes and number of places of each
    segment, and whether its anchor has many places; with bytes, equal segments of a batch are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, data, at in pieces(unpacked(batch.column(3))):
                items, _, _, first = scheme.items(data, at)
                hit, is_hot = np.zeros(len(items) + 1, bool), np.zeros(len(items) + 1, bool)
                for i in range(len(at) - 1):
                    hit[first[i] + batch.column(2)[row + i].values.to_numpy()] = True
                    is_hot[first[i] + batch.column(4)[row + i].values.to_numpy()] = True
                key, h1, h2, place, a, b = _runs(scheme, items, first, hit)
                if not len(a):
                    continue
                owner = np.searchsorted(first, a, "right") - 1
                if with_bytes:
                    once = _once(key, h1, h2, copies[row + owner], a, b, data.tobytes())
                    hot = dict(zip(key.tolist(), is_hot[place].tolist()))  # the same for all places of an anchor
                    yield pa.RecordBatch.from_arrays([*once, pa.array([hot[k] for k in once[0].to_pylist()])], [*KEY, "m", "segment", "hot"])
                    continue
                own = copies[row + owner] == 1
                yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (key, h1, h2, cids[row + owner], (a - first[owner]).astype(np.int32))], [*KEY, "cid", "start"])

    return run


def _finer(scheme: Scheme, with_bytes: bool):
    """The same for segments that are taken for texts: rows of the parts with their bytes, or with the
    segment (s0, s1, s2) and the place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents, m = [batch.column(i).to_numpy() for i in range(3)], batch.column(3).to_numpy()
            for row, data, at in pieces(batch.column(4)):
                items, _, _, first = scheme.items(data, at)
                key, h1, h2, _, a, b = _runs(scheme, items, first, np.ones(len(items) + 1, bool))
                owner = np.searchsorted(first, a, "right") - 1
                if with_bytes:
                    yield pa.RecordBatch.from_arrays(_once(key, h1, h2, m[row + owner], a, b, data.tobytes()), [*KEY, "m", "segment"])
                else:
                    columns = [key, h1, h2, *[p[row + owner] for p in parents], (a - first[owner]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [*KEY, "s0", "s1", "s2", "start"])

    return run


def _runs(scheme: Scheme, items: np.ndarray, first: np.ndarray, hit: np.ndarray):
    """Key of the anchor, digest, place of the anchor, start and end of every segment: the bytes of all windows
    with one anchor, for the anchors at the places ``hit``."""
    hashes, chosen, whole = scheme.anchors(items, first)
    start = np.flatnonzero(whole & hit[chosen])
    if not len(start):
        return [np.zeros(0, np.int64)] * 6
    anchor = chosen[start]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(start) != 1)]))
    a, b = start[new], start[np.concatenate([new[1:] - 1, [len(start) - 1]])] + scheme.length
    h1, h2 = _digest(items, a, b, scheme.length)
    return hashes[anchor[new]].view(np.int64), h1, h2, anchor[new], a, b


def _once(key: np.ndarray, h1: np.ndarray, h2: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, raw: bytes) -> list[pa.Array]:
    """Columns key, h1, h2, m, segment with equal segments put together."""
    seen: dict = {}
    for k, (x, y, z, n) in enumerate(zip(key.tolist(), h1.tolist(), h2.tolist(), m.tolist())):
        old = seen.setdefault((x, y, z), [k, 0])
        old[1] += n
    at = [k for k, _ in seen.values()]
    return [*[pa.array(x[at]) for x in (key, h1, h2)], pa.array([n for _, n in seen.values()], pa.int64()), pa.array([raw[a[k] : b[k]] for k in at], pa.binary())]


def _digest(items: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of items[a:b] for each pair, from its size and hashes of four runs that cover it:
    a segment has ``length`` items at least and fewer than twice as many."""
    size = length // 2
    half, n = run_hashes(items, size), (b - a).astype(np.uint64)
    h1 = half[a] * np.uint64(3) + half[a + size] * np.uint64(5) + n
    h2 = half[b - size] * np.uint64(7) + half[np.minimum(a + 2 * size, b - size)] * np.uint64(11) + n
    return h1.view(np.int64), h2.view(np.int64)


def _expand(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list = []  # (anchor, h1, h2, m, segment) of anchors with several segments
        size, group = 0, {}

        def solve() -> pa.RecordBatch:
            found = repeated_starts([p[4] for p in pending], length)
            starts = [np.arange(len(p[4]) - length + 1) if p[3] > 1 else f for p, f in zip(pending, found)]
            rows = [(p[0], p[1], p[2], s.astype(np.int32)) for p, s in zip(pending, starts) if len(s)]
            pending.clear()
            return table(rows)

        def table(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.list_(pa.int32()))], ["anchor", "h1", "h2", "starts"])

        def close() -> list:
            """Ends an anchor; rows that need no expansion."""
            nonlocal size
            own = list(group.values())
            group.clear()
            if len(own) == 1:
                a, x, y, m, s = own[0]
                return [(a, x, y, np.arange(max(1, len(s) - length + 1), dtype=np.int32))] if m > 1 else []
            pending.extend(own)
            size += sum(len(p[4]) for p in own)
            return []

        now = None
        for batch in batches:
            plain = []
            for a, x, y, m, s in zip(*[c.to_pylist() for c in batch.columns]):
                if a != now:
                    plain += close()
                    now = a
                    if size >= TASK_BYTES:
                        yield solve()
                        size = 0
                if (x, y) in group:
                    group[x, y][3] += m
                else:
                    group[x, y] = [a, x, y, m, s]
            yield table(plain)
        yield table(close())
        if pending:
            yield solve()

    return run


def _expanded(segments: DataFrame, length: int) -> DataFrame:
    """anchor, h1, h2, starts: the repeated windows of each segment, by interval expansion."""
    at_task = segments.select(*KEY, "m", "segment").repartition("anchor").sortWithinPartitions("anchor")
    return at_task.mapInArrow(_expand(length), "anchor long, h1 long, h2 long, starts array<int>")


def _of_crowded(segments: DataFrame, scheme: Scheme) -> DataFrame:
    """The same for segments of anchors with many places. Equal ones are put together within tasks before they
    are shuffled; where too many different ones are left, they are cut at anchors of longer seeds."""
    one = stored(segments.groupBy(*KEY).agg(F.sum("m").alias("m"), F.first("segment").alias("segment")), "segments")
    if scheme.seed == scheme.length:  # one different segment an anchor
        return _expanded(one, scheme.length)
    crowded = stored(one.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > seeds.HOT_PLACES).select("anchor"), "crowded-anchors")
    if crowded.isEmpty():
        return _expanded(one, scheme.length)
    inside = stored(one.join(crowded, "anchor", "left_semi"), "crowded-segments")
    finer = Scheme(scheme.unit, scheme.length, (scheme.seed + scheme.length + 1) // 2)
    found = _of_crowded(inside.mapInArrow(_finer(finer, True), SEGMENT), finer)
    places = inside.mapInArrow(_finer(finer, False), "anchor long, h1 long, h2 long, s0 long, s1 long, s2 long, start int")
    moved = places.join(found, KEY).select("s0", "s1", "s2", F.transform("starts", lambda x: x + F.col("start")).alias("starts"))
    # A segment has fewer windows than a window has bytes, so its list is short.
    whole = moved.groupBy(F.col("s0").alias("anchor"), F.col("s1").alias("h1"), F.col("s2").alias("h2")).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return _expanded(one.join(crowded, "anchor", "left_anti"), scheme.length).unionByName(whole)


def dedup_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, seed: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (null: unchanged) of every row."""
    scheme = Scheme("byte", length, seed)
    texts = keyed(docs, text)
    classes = text_classes(texts, scheme)
    shared = texts_with_shared_anchors(texts, classes)
    segments = shared.mapInArrow(_segments(scheme, True), f"{SEGMENT}, hot boolean")
    found = _expanded(segments.filter(~F.col("hot")), length)
    with_hot = shared.filter(F.size("hot") > 0)
    if not with_hot.isEmpty():
        hot = with_hot.mapInArrow(_segments(scheme, True), f"{SEGMENT}, hot boolean").filter("hot")
        found = found.unionByName(_of_crowded(hot, scheme))
    places = shared.mapInArrow(_segments(scheme, False), "anchor long, h1 long, h2 long, cid long, start int")
    windows = places.join(found, KEY).select("cid", F.transform("starts", lambda x: x + F.col("start")).alias("starts"))
    results = without_windows(classes, shared, windows, scheme)
    return per_document(docs, doc_id, text, results, [F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept_text"])
