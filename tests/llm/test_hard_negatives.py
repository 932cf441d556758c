"""Hard negatives against all pairs, the curve and the bounds."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegauge.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def mine(table, **options):
    return hn.hard_negatives(table, F.col("vec_id") % 10 == 0, F.col("label"), **options)


def plain(rows, positives=5, negatives=10):
    taken = []
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, v, label) in enumerate(taken):
        if i is None or i % 10:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, m) for b, (j, w, m) in enumerate(taken) if b != a and len(w) == len(v)]
        for p, positive, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fit = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p]
            out += [(i, positive, n, s[1], p, s[0]) for n, s in enumerate(sorted(fit, key=order)[:negatives], 1)]
    return sorted(out, key=str)


def rows_of(n, dim, labels, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((labels, dim)) * 0.5 + 0.4
    rows = [(i, [float(x) for x in np.float32(centres[i % labels] + 0.5 * rnd.standard_normal(dim))], int(i % labels if i % 3 else rnd.integers(labels))) for i in range(n)]
    return rows


@pytest.mark.parametrize("options", [{}, {"block_rows": 7, "group_rows": 4, "pack_blocks": 5, "groups_at_once": 2}])
def test_equals_all_pairs(spark, options):
    rows = rows_of(300, 6, 3, 1)
    rows += [(i + 1000, v, m) for i, v, m in rows[:40]]  # ties
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted((tuple(r) for r in mine(table, **options).collect()), key=str) == plain(rows)


def test_blocks_are_skipped(spark):
    """Clusters far apart: most pairs of groups and blocks are never read, and nothing is lost."""
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(600):
        v = np.zeros(12)
        v[i % 6] = 1
        v[6 + i % 6] = 0.6
        rows.append((i, [float(x) for x in np.float32(v + 0.02 * rnd.standard_normal(12))], i % 2 if i % 6 else 1))
    table = spark.createDataFrame(rows, SCHEMA)
    flat = table.select("vec_id", F.col("label").cast("long").alias("label"), (F.col("vec_id") % 10 == 0).alias("anchor"), F.col("embedding").cast("array<double>").alias("vector"))
    blocks = hn.Blocks(hn.quantised(flat, 256.0), 10, 4, 8, 4)
    one = spark.createDataFrame([(g.group, s, 0, hn.LEAST, hn.MOST, 40000) for g in blocks.groups.collect() for s in range(len(g.ids) // 8)], "group long, slot long, window long, low long, high long, floor long")
    chosen = blocks._chosen(hn._packed(one), True, 5, seeds=0).count()
    assert 0 < chosen < 0.5 * blocks.blocks.count() * blocks.groups.count()
    assert sorted((tuple(r) for r in mine(table, block_rows=10, group_rows=4).collect()), key=str) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 0.5]
    rows = [(0, v, 1), (1, None, 1), (2, [], 1), (3, [nan, 1.0], 1), (4, [None, 1.0], 1), (5, [inf, 1.0], 2), (6, v, None), (7, v, 1), (None, v, 1), (8, [0.6, 0.3], 2), (9, [1.0], 2), (None, [0.5, 0.3], 2), (0, v, 1), (10, [-1.0, 0.0], 2)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "'x' AS place", "0 AS block")
    assert sorted((tuple(r) for r in mine(table).collect()), key=str) == plain(rows)
    large = rows + [(20, [1e30, 1e30], 1)]  # its products fit no long
    assert sorted((tuple(r) for r in mine(spark.createDataFrame(large, SCHEMA)).collect()), key=str) == plain(rows)


def test_empty_table(spark):
    assert mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = hn.hilbert(points, bits)
        assert sorted(place) == list(range(len(points)))
        along = points[np.argsort(place)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rnd = np.random.default_rng(4)
    block, anchors = rnd.integers(-300, 300, (50, 9)), rnd.integers(-300, 300, (20, 9))
    low, high = hn.bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
    score = anchors @ block.T
    assert (low[:, 0] <= score.min(axis=1)).all() and (high[:, 0] >= score.max(axis=1)).all()
    big = np.array([[hn.largest_component(3)] * 3])
    assert hn.inner(big, -big)[0, 0] == -3 * hn.largest_component(3) ** 2
