"""Hard negatives from candidate blocks on a Hilbert curve with zone maps.

Vectors are quantised to whole numbers, sorted by label and by their place on a Hilbert curve, and written as
Parquet, one row per block of neighbours with one label. A block's zone map holds the least and the
greatest value of every dimension. For an anchor, interval arithmetic on these gives the least and the
greatest inner product that any row of a block can have.

Both searches are the same: the best ``k`` rows per window, a range of scores of rows with the anchor's label
(positives) or with another (negatives). First each window reads the few blocks that can reach furthest into
it; the k-th best score found there is its floor. Then it reads exactly the blocks whose bounds meet the
window at or above the floor, equal scores included, so the result is exact.

Anchors lie in groups, ordered as the candidates are. Zone maps lie in packs. A task bounds some groups against
one pack, or scores a bounded number of groups against one block that was chosen for them; all
other pairs of groups and blocks are never formed.

Defined results: rows with a null label, a null or empty vector, or a null or non-finite component take no part, nor
do components so large that an inner product of the table's dimension need not fit a long. Vectors of different
dimension are never compared. Rows are told apart by a number of their own, so a repeated row is a
candidate for its copy, and a repeated anchor is answered once per row. Ties go to the smaller id, a null id
last. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.llm.common import stored

#: Dimensions and bits per dimension that place a vector on the curve; together at most 63 bits.
CURVE_DIMS, CURVE_BITS = 10, 6
LEAST, MOST = -(1 << 62), 1 << 62
NO_ID = np.iinfo(np.int64).max


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of ``points`` (whole numbers of ``bits`` bits), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def curve_place(vectors: np.ndarray) -> np.ndarray:
    """Directions on the curve: a few evenly spaced dimensions, scaled by the length of the vector."""
    dim = vectors.shape[1]
    chosen = np.unique(np.linspace(0, dim - 1, min(dim, CURVE_DIMS)).astype(int))
    length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1, keepdims=True)) + 1e-300
    scaled = (vectors[:, chosen] / length * np.sqrt(dim) + 2.5) / 5
    return hilbert(np.clip(scaled * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64), CURVE_BITS)


def largest_component(dim: int) -> int:
    """Components up to this size have inner products that fit a long, also a hundred times over."""
    return min((1 << 31) - 1, isqrt((1 << 56) // dim))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``least`` and ``most`` of each block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return inner(up, least) + inner(down, most), inner(up, most) + inner(down, least)


# --- layout -----------------------------------------------------------------------------------


def _bytes(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, dim)


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """row, vec_id, label, anchor, dim, vector (packed whole numbers) and place on the curve of all rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            flat = batch.column("vector").flatten().to_numpy()
            ends = np.cumsum(dims)
            packed, places = [None] * len(dims), np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                values = np.floor(scale * flat[(ends[own] - dim)[:, None] + np.arange(dim)])
                fits = (np.abs(values) <= largest_component(int(dim))).all(axis=1)
                own, values = own[fits], values[fits].astype(np.int64)
                places[own] = curve_place(values) if len(own) else 0
                for i, v in zip(own, values.astype(np.int32)):
                    packed[i] = v.tobytes()
            kept = np.flatnonzero([p is not None for p in packed])
            names = ["row", "vec_id", "label", "anchor", "dim"]
            columns = [batch.column(n).take(pa.array(kept)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([packed[i] for i in kept], pa.binary()), pa.array(places[kept])], [*names, "vector", "place"])

    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(v) > 0)
    whole = rows.filter(finite & F.col("label").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), F.size(v).alias("dim"), "vector"
    )
    return stored(whole.mapInArrow(run, "row long, vec_id long, label long, anchor boolean, dim int, vector binary, place long"), "quantised")


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], size: int) -> Iterator[dict[str, list]]:
    """Runs of at most ``size`` consecutive rows that agree in all but the last three columns."""
    held: dict[str, list] = {n: [] for n in names}
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        for values in zip(*columns):
            last = [held[n][-1] for n in names[:-3]] if held[names[0]] else None
            if last is not None and (len(held[names[0]]) == size or last != list(values[:-3])):
                yield held
                held = {n: [] for n in names}
            for n, x in zip(names, values):
                held[n].append(x)
    if held[names[0]]:
        yield held


def blocks_of(table: DataFrame, block_rows: int) -> DataFrame:
    """Candidate blocks with their zone maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, held in enumerate(_runs(batches, ["dim", "label", "vec_id", "row", "vector"], block_rows)):
            dim = held["dim"][0]
            vectors = _matrix(b"".join(held["vector"]), dim)
            ids = [NO_ID if i is None else i for i in held["vec_id"]]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": first + n,
                        "dim": dim,
                        "label": held["label"][0],
                        "ids": _bytes(ids, np.int64),
                        "rows": _bytes(held["row"], np.int64),
                        "vectors": vectors.tobytes(),
                        "least": _bytes(vectors.min(axis=0), np.int32),
                        "most": _bytes(vectors.max(axis=0), np.int32),
                    }
                ]
            )

    sort = [F.col(c) for c in ("dim", "label", "place", "row")]
    ordered = table.repartitionByRange(*sort).sortWithinPartitions(*sort).select("dim", "label", "vec_id", "row", "vector")
    return stored(ordered.mapInArrow(run, "block long, dim long, label long, ids binary, rows binary, vectors binary, least binary, most binary"), "blocks")


def zones_of(blocks: DataFrame, pack_blocks: int) -> DataFrame:
    """Zone maps in packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, ["dim", "block", "label", "zone"], pack_blocks):
            zone = [_matrix(z, held["dim"][0]) for z in held["zone"]]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "dim": held["dim"][0],
                        "blocks": _bytes(held["block"], np.int64),
                        "labels": _bytes(held["label"], np.int64),
                        "leasts": b"".join(z[0].tobytes() for z in zone),
                        "mosts": b"".join(z[1].tobytes() for z in zone),
                    }
                ]
            )

    zones = blocks.select("dim", "block", "label", F.concat("least", "most").alias("zone")).repartitionByRange("dim", "block").sortWithinPartitions("dim", "block")
    return numbered(zones.mapInArrow(run, "dim long, blocks binary, labels binary, leasts binary, mosts binary"), "pack")


def groups_of(table: DataFrame, group_rows: int) -> DataFrame:
    """Anchors in groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, ["dim", "label", "vec_id", "row_vector"], group_rows):
            rows, vectors = zip(*((v["row"], v["vector"]) for v in held["row_vector"]))
            ids = [NO_ID if i is None else i for i in held["vec_id"]]
            yield pa.RecordBatch.from_pylist(
                [{"dim": held["dim"][0], "ids": _bytes(ids, np.int64), "rows": _bytes(rows, np.int64), "labels": _bytes(held["label"], np.int64), "vectors": b"".join(vectors)}]
            )

    sort = [F.col(c) for c in ("dim", "label", "place", "row")]
    ordered = table.filter("anchor").repartitionByRange(*sort).sortWithinPartitions(*sort)
    columns = ordered.select("dim", "label", "vec_id", F.struct("row", "vector").alias("row_vector"))
    return numbered(columns.mapInArrow(run, "dim long, ids binary, rows binary, labels binary, vectors binary"), "group")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows of few large values, written with a number."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), name)


# --- windows ----------------------------------------------------------------------------------


class Blocks:
    """Candidates and anchors of a table, ready for searches by window."""

    def __init__(self, table: DataFrame, block_rows: int, group_rows: int, pack_blocks: int, groups_at_once: int) -> None:
        self.table = table
        self.blocks = blocks_of(table, block_rows)
        self.zones = zones_of(self.blocks, pack_blocks)
        self.groups = groups_of(table, group_rows)
        self.n_packs, self.n_groups = self.zones.count(), self.groups.count()
        self.at_once = groups_at_once

    def search(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The best ``k`` rows of every window (group, slot, window, low, high): group, slot, window, rank, score, vec_id, row."""
        seeds = self._read(self._chosen(_packed(windows.withColumn("floor", F.col("low"))), same, k, seeds=2), k, same)
        worst = self._best(seeds, k).filter(F.col("rank") == k).select("group", "slot", "window", F.col("score").alias("found"))
        floors = windows.join(worst, ["group", "slot", "window"], "left").withColumn("floor", F.coalesce("found", "low")).drop("found")
        return self._best(self._read(self._chosen(_packed(floors), same, k, seeds=0), k, same), k)

    def _chosen(self, windows: DataFrame, same: bool, k: int, seeds: int) -> DataFrame:
        """(group, block) pairs whose bounds meet a window; with ``seeds`` only so many of each window and pack, those that
        reach furthest. Kept with the groups' windows."""
        groups = self.groups.join(windows, "group")
        shares = max(1, -(-self.n_groups // self.at_once))
        packs = max(1, self.n_packs)
        left = groups.withColumn("share", _share("group", shares)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
        right = self.zones.select(F.col("dim").alias("zone_dim"), _share("pack", packs).alias("slice"), "blocks", F.col("labels").alias("block_labels"), "leasts", "mosts")
        right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["dim"] != r["zone_dim"]:
                        continue
                    anchors, labels = _matrix(r["vectors"], r["dim"]), np.frombuffer(r["labels"], np.int64)
                    low, high = bounds(anchors, _matrix(r["leasts"], r["dim"]), _matrix(r["mosts"], r["dim"]))
                    agree = labels[:, None] == np.frombuffer(r["block_labels"], np.int64)
                    slots, _, _, most, floor = _unpacked(r["windows"])
                    low, high = low[slots], np.minimum(high[slots], most[:, None])
                    meets = (agree[slots] == same) & (low <= most[:, None]) & (high >= floor[:, None])
                    if seeds and meets.shape[1] > seeds:
                        reach = np.where(meets, high, LEAST)
                        order = np.argpartition(-reach, seeds - 1, axis=1)[:, :seeds]
                        first = np.zeros_like(meets)
                        np.put_along_axis(first, order, True, axis=1)
                        meets &= first
                    wanted = np.frombuffer(r["blocks"], np.int64)[meets.any(axis=0)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wanted), r["group"], np.int64)), pa.array(wanted)], ["group", "block"])

        cells = left.drop("ids", "rows").join(right, ["slice", "share"])
        pairs = stored(cells.mapInArrow(run, "group long, block long"), "chosen-blocks")
        return pairs.join(groups, "group")

    def _read(self, chosen: DataFrame, k: int, same: bool) -> DataFrame:
        """Scores of the chosen blocks: at most ``k`` rows of each window and block, not below the floor."""
        shares = max(1, -(-self.n_groups // self.at_once))
        left = chosen.withColumn("share", _share("group", shares))
        left = left.select("block", "share", "group", "dim", "windows", "labels", F.col("rows").alias("anchor_rows"), F.col("vectors").alias("anchors"))
        needed = left.select("block", "share").distinct()
        right = self.blocks.select("block", F.col("ids").alias("block_ids"), F.col("rows").alias("block_rows"), F.col("vectors").alias("block_vectors"), F.col("label").alias("block_label")).join(needed, "block")
        right = right.select(F.col("block").alias("its_block"), F.col("share").alias("its_share"), "block_ids", "block_rows", "block_vectors", "block_label")

        def cell(groups: pa.Table, block: pa.Table) -> pa.Table:
            out = [[] for _ in range(6)]
            if len(groups) and len(block):
                b = block.slice(0, 1).to_pylist()[0]
                ids, rows = np.frombuffer(b["block_ids"], np.int64), np.frombuffer(b["block_rows"], np.int64)
                for g in groups.to_pylist():
                    score = inner(_matrix(g["anchors"], g["dim"]), _matrix(b["block_vectors"], g["dim"]))
                    own = np.frombuffer(g["anchor_rows"], np.int64)
                    slots, windows, low, high, floor = _unpacked(g["windows"])
                    asks = (np.frombuffer(g["labels"], np.int64)[slots] == b["block_label"]) == same
                    slots, windows, low, high, floor = slots[asks], windows[asks], low[asks], high[asks], floor[asks]
                    score = score[slots]
                    near = (score >= np.maximum(floor, low)[:, None]) & (score <= high[:, None]) & (rows != own[slots][:, None])
                    for w in np.flatnonzero(near.sum(axis=1) > k):
                        at = np.flatnonzero(near[w])
                        at = at[score[w, at] >= np.partition(score[w, at], -k)[-k]]
                        near[w] = False
                        near[w, at[np.lexsort((rows[at], ids[at], -score[w, at]))[:k]]] = True
                    w, at = np.nonzero(near)
                    for column, values in zip(out, (np.full(len(w), g["group"]), slots[w], windows[w], score[w, at], ids[at], rows[at])):
                        column.append(values)
            columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
            return pa.table(dict(zip(["group", "slot", "window", "score", "vec_id", "row"], columns)))

        pairs = left.groupBy("block", "share").cogroup(right.groupBy("its_block", "its_share"))
        return pairs.applyInArrow(cell, "group long, slot long, window long, score long, vec_id long, row long")

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("group", "slot", "window").orderBy(F.desc("score"), "vec_id", "row")
        return stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")


def _share(number: str, shares: int) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(shares)).cast("int")


def _packed(windows: DataFrame) -> DataFrame:
    """One row per group with all its windows; a group has at most its rows times the windows of an anchor."""
    return windows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("slot", "window", "low", "high", "floor"))).alias("windows"))


def _unpacked(windows: list[dict]) -> tuple[np.ndarray, ...]:
    return tuple(np.array([w[c] for w in windows], np.int64) for c in ("slot", "window", "low", "high", "floor"))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    label: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
    scale: float = 256.0,
    block_rows: int = 512,
    group_rows: int = 256,
    pack_blocks: int = 1024,
    groups_at_once: int = 16,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For every row where ``anchor`` holds: its best ``positives`` rows of the same ``label``, and for each of them the
    best ``negatives`` rows of other labels whose score lies between the given percentages of the positive's.
    Scores are inner products of ``floor(scale * component)``.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), anchor.alias("anchor"), F.col(vector).cast("array<double>").alias("vector"))
    table = quantised(rows, scale)
    blocks = Blocks(table, block_rows, group_rows, pack_blocks, groups_at_once)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), group)), pa.array(np.arange(len(ids))), pa.array(ids)], ["group", "slot", "anchor_id"])

    anchors = stored(blocks.groups.select("group", "ids").mapInArrow(members, "group long, slot long, anchor_id long"), "anchors")
    whole = anchors.select("group", "slot", F.lit(0).cast("long").alias("window"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    found = blocks.search(whole, positives, same=True)
    found = found.select("group", "slot", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # least * p <= 100 * n <= most * p in whole numbers; a negative p leaves no n.
    low, high = f"{least_percent}L * positive_score", f"{most_percent}L * positive_score"
    exact = {"low": F.expr(f"({low} + pmod(-({low}), 100)) div 100"), "high": F.expr(f"({high} - pmod({high}, 100)) div 100")}
    windows = found.withColumns(exact).filter("low <= high").select("group", "slot", "window", "low", "high")
    mined = blocks.search(windows, negatives, same=False)
    no_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (
        mined.withColumnRenamed("vec_id", "negative_id")
        .join(found, ["group", "slot", "window"])
        .join(anchors, ["group", "slot"])
        .select(no_id("anchor_id").alias("anchor_id"), no_id("positive_id").alias("positive_id"), "rank", no_id("negative_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )

