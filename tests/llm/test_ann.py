"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tracegauge.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, (i, v) in enumerate(rows):
        if i is not None and i % 5 == 0:
            scores = [(-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for c, (j, w) in enumerate(rows) if c != q and len(w) == len(v)]
            out[i] = sorted(scores)[:k]
    return out


def test_recall_scores_and_cells(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.standard_normal((8, 48))
    rows = [(i, [float(x) for x in np.float32(centres[i % 8] + 0.7 * rnd.standard_normal(48))]) for i in range(400)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {}
    for r in nearest(table, F.col("vec_id") % 5 == 0, shard_rows=64, group_queries=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want, hits = brute(rows, 5), 0
    for q, best in want.items():
        own = sorted(got[q])
        assert [n for n, _, _ in own] == [1, 2, 3, 4, 5]
        hits += len({v for _, v, _ in own} & {j for _, j in best})
        for _, v, s in own:
            a, b = (np.array(rows[x][1], np.float32).astype(float) for x in (q, v))
            assert abs(s - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
    assert hits / (5 * len(want)) > 0.98


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, None]), (10, [1.0, 2.0, 3.0]), (None, [2.0, 2.0]), (0, [1.0, 0.0])]
    got = nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 5 == 0).collect()
    best = sorted(((r.query_id, r.rank, r.vec_id) for r in got), key=str)
    assert best == sorted([(0, n, v) for n, v in enumerate([0, 6, 7, None], 1)] * 2, key=str)


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0
