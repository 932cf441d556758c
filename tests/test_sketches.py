"""Sketches merged over any range keep their stated errors and do not read the requests again."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from tracegauge.operators import sketches as sk


def table(spark, days=12, per_day=3000):
    rnd = random.Random(1)
    rows = [("A" if rnd.random() < 0.7 else "B", datetime.datetime(2024, 1, 1 + d, rnd.randrange(24)), int(rnd.lognormvariate(8, 1) + 50 * d)) for d in range(days) for _ in range(per_day)]
    rows += [("A", datetime.datetime(2024, 1, 3), None), ("A", None, 7), (None, datetime.datetime(2024, 1, 3), 5)]
    return rows, spark.createDataFrame(rows, "agent_name string, start_ts timestamp, duration_ms bigint")


def test_any_range_keeps_the_stated_errors(spark, tmp_path):
    rows, df = table(spark)
    path = str(tmp_path / "s")
    sk.write_sketches(sk.daily_sketches(df.filter("start_ts < '2024-01-07'")), path)
    sk.write_sketches(sk.daily_sketches(df.filter("start_ts >= '2024-01-07' OR start_ts IS NULL")), path)
    stored = sk.read_sketches(spark, path)
    for low, high in ((1, 12), (3, 3), (5, 9)):
        first, last = (F.lit(datetime.date(2024, 1, d)) for d in (low, high))
        got = {r.agent_name: r for r in sk.estimates(sk.merged(stored, first, last), {"p50": 0.5, "p99": 0.99}).collect()}
        for agent in {a for a, t, _ in rows if t is not None and low <= t.day <= high}:
            own = [(v) for a, t, v in rows if a == agent and t is not None and low <= t.day <= high]
            values = np.sort([v for v in own if v is not None])
            r = got[agent]
            assert (r.n_rows, r.n_values) == (len(own), len(values))
            assert abs(r.n_distinct - len(set(values))) <= max(1, sk.distinct_error() * len(set(values)))
            for share, value in ((0.5, r.p50), (0.99, r.p99)):
                assert np.searchsorted(values, value, "left") / len(values) <= share + sk.RANK_ERROR
                assert np.searchsorted(values, value, "right") / len(values) >= share - sk.RANK_ERROR
    plan = sk.merged(stored, F.lit(datetime.date(2024, 1, 5)), F.lit(datetime.date(2024, 1, 9)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(day" in plan


def test_no_values_and_no_rows(spark):
    one = spark.createDataFrame([("A", datetime.datetime(2024, 1, 1), None)], "agent_name string, start_ts timestamp, duration_ms bigint")
    got = sk.estimates(sk.merged(sk.daily_sketches(one)), {"p50": 0.5}).first()
    assert (got.n_rows, got.n_values, got.n_distinct, got.p50) == (1, 0, 0, None)
    assert sk.merged(sk.daily_sketches(one.limit(0))).count() == 0
    ranked = sk.merged(sk.daily_sketches(one.fillna(7)))
    assert ranked.select(sk.rank_of(ranked, F.lit(7).cast("bigint")).alias("r")).first().r == 1.0
