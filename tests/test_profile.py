import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegauge.operators import profile
from tracegauge.operators.profile import PARTS, approximate_percentiles, part_of, value_profile, zone_of
from tracegauge.operators.scratch import materialize

POINTS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}


def check(spark, groups, kind):
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(5)
    got = {r.g: r for r in value_profile(df, ["g"], "v", POINTS, sums={"big": (F.col("v") > 10).cast("int")}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        known = [v for v in vs if v is not None]
        r = got[g]
        assert (r.n_rows, r.n_values, r.n_distinct) == (len(vs), len(known), len(set(known)))
        if not known:
            assert r.v_min is None and r.p50 is None
            continue
        assert (r.v_min, r.v_max, r.big) == (min(known), max(known), sum(v > 10 for v in known))
        assert r.v_sum == pytest.approx(sum(known))
        assert r.v_m2 == pytest.approx(float(np.var(known)) * len(known), rel=1e-9, abs=1e-12)
        for name, p in POINTS.items():
            assert r[name] == pytest.approx(float(np.percentile(known, p * 100))), (g, name)


def test_whole_numbers_with_a_hot_value_null_keys_and_null_values(spark):
    rnd = random.Random(1)
    groups = {
        "hot": [700] * 3000 + [rnd.randrange(100000) for _ in range(1500)],
        "one": [7],
        "two": [1, 2],
        "negative": [rnd.randrange(-5000, 5000) for _ in range(301)],
        "holes": [None, 5, None, 9],
        "empty": [None, None],
        None: [3, 4, 5],
    }
    check(spark, groups, "bigint")


def test_fractions(spark):
    rnd = random.Random(2)
    check(spark, {"a": [rnd.random() for _ in range(997)], "b": [1.0] * 50 + [0.999], "c": [rnd.choice([0.05, 0.45, None]) for _ in range(100)]}, "double")


def test_spread_of_large_close_values(spark):
    check(spark, {"a": [1e6 + i / 8 for i in range(400)], "b": [-1e6 - i / 8 for i in range(3)], "c": [5.0]}, "double")


def test_values_of_any_size(spark):
    rnd = random.Random(5)
    tiny = [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** -rnd.randrange(1, 300) for _ in range(2000)]
    check(spark, {"tiny": tiny, "edges": [0.0, -0.0, 5e-324, -5e-324, 1.0, 1 - 2**-53, 2.0, 2 - 2**-52], "wide": [1e150, 2e150, 0.5, None]}, "double")


def test_infinite_values_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", v) for v in (-inf, 1.0, 2.0, inf, inf)] + [("b", v) for v in (nan, -1.0, 1.0)], "g string, v double")
    got = {r.g: r for r in value_profile(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p100": 1.0}).collect()}
    assert (got["a"].p0, got["a"].p50, got["a"].p100, got["a"].n_distinct) == (-inf, 2.0, inf, 4)
    assert (got["b"].p0, got["b"].p50) == (-1.0, 1.0) and math.isnan(got["b"].p100)


def test_zones_and_parts_keep_the_order(spark):
    rnd = random.Random(6)
    values = sorted({rnd.choice([-1, 1]) * math.ldexp(1 + rnd.choice([0, 2**-52, rnd.random(), 1 - 2**-52]), rnd.randrange(-1070, 1023)) for _ in range(5000)} | {0.0})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", zone_of(F.col("v")).alias("z"), part_of(F.col("v"), F.lit(values[0]), F.lit(values[-1])).alias("p")).collect()
    rows.sort(key=lambda r: r.v)
    assert all(a.z <= b.z and a.p <= b.p for a, b in zip(rows, rows[1:]))
    assert {r.p for r in rows} <= set(range(PARTS + 1))


@pytest.mark.parametrize("most", [1, 8])
def test_cuts_do_not_change_results(spark, monkeypatch, most):
    monkeypatch.setattr(profile, "MOST_SORTED", most)
    monkeypatch.setattr(profile, "PARTS", 4)
    rnd = random.Random(7)
    check(spark, {"a": [rnd.random() for _ in range(200)] + [0.5] * 90, "b": [0.7 + i * 1e-15 for i in range(60)], "c": [None, None], None: [1.0, 2.0]}, "double")


def test_whole_numbers_that_share_a_double(spark, monkeypatch):
    monkeypatch.setattr(profile, "MOST_SORTED", 2)
    df = spark.range(2**62, 2**62 + 20).select(F.lit("x").alias("g"), F.col("id").alias("v"))
    assert value_profile(df, ["g"], "v", {"p50": 0.5}).first().n_distinct == 20


def test_a_million_values_within_a_thousandth(spark, monkeypatch):
    """What is sorted in the end is small: the opened parts are the last table written."""
    written = []

    def kept(df, name):
        written.append(materialize(df, name))
        return written[-1]

    monkeypatch.setattr(profile, "materialize", kept)
    df = spark.range(10**6).select(F.lit("x").alias("g"), (F.lit(0.5) + F.col("id") * F.lit(1e-9)).alias("v"))
    got = value_profile(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert got.n_distinct == 10**6
    assert got.p50 == pytest.approx(0.5 + 499999.5e-9, abs=1e-12) and got.p90 == pytest.approx(0.5 + 899999.1e-9, abs=1e-12)
    assert written[1].agg(F.max("_in")).first()[0] > profile.MOST_SORTED
    assert written[-1].agg(F.max("_in")).first()[0] <= 64


def test_no_rows(spark):
    assert value_profile(spark.createDataFrame([], "g string, v bigint"), ["g"], "v", POINTS).count() == 0


def test_sketch_is_close(spark):
    df = spark.range(10001).select(F.lit("x").alias("g"), F.col("id").alias("v"))
    assert abs(approximate_percentiles(df, ["g"], "v", {"p": 0.9}).first().p - 9000) <= 2
