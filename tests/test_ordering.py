import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracegauge.operators import ordering
from tracegauge.operators.ordering import MOST_SORTED, extreme_rows, in_ranges, ranked_head, with_position, with_rank
from tracegauge.operators.scratch import materialize

T0 = datetime.datetime(2024, 1, 1)


def test_positions_of_a_hot_group_over_many_zones(spark):
    rnd = random.Random(3)
    rows = [("hot", T0 + datetime.timedelta(seconds=rnd.randrange(4000)), i) for i in range(2000)]
    rows += [(f"k{i}", T0, i) for i in range(50)] + [("hot", None, -1), (None, T0, 5)]
    df = spark.createDataFrame(rows, "k string, t timestamp, i bigint").repartition(4)
    got = {(r.k, r.i): r.position for r in with_position(df, ["k"], "t", ["i"]).collect()}
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[1] is not None, r[1] or T0, r[2]))
    assert [got["hot", r[2]] for r in hot] == list(range(1, len(hot) + 1))
    assert all(got[f"k{i}", i] == 1 for i in range(50)) and len(got) == len(rows) - 1


def test_positions_without_zones_of_use(spark, monkeypatch):
    """Times that are all NULL or all equal, a column without a hash, several groups."""
    monkeypatch.setattr(ordering, "MOST_SORTED", 16)
    rnd = random.Random(4)
    rows = [("null", None, i, {}) for i in range(150)] + [("equal", T0, i, {"x": i}) for i in range(150)] + [(f"k{i % 9}", T0, i, None) for i in range(40)]
    rows += [("twice", T0, 7, {"y": 1})] * 30 + [(None, T0, 5, {})]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t timestamp, i bigint, m map<string,int>").repartition(4)
    out = with_position(df, ["k"], "t", [F.col("i").desc()])
    assert out.columns == ["k", "t", "i", "m", "position"]
    got = {}
    for r in out.collect():
        got.setdefault(r.k, []).append((r.position, r.i))
    assert set(got) == {r[0] for r in rows} - {None}
    for k, found in got.items():
        want = sorted((r[2] for r in rows if r[0] == k), reverse=True)
        assert sorted(found) == list(enumerate(want, 1)), k


@pytest.mark.parametrize("start", ["null", "equal"])
def test_a_million_rows_of_one_trace(spark, start):
    t = F.lit(None if start == "null" else T0).cast("timestamp")
    df = spark.range(10**6).select(F.lit("x").alias("k"), t.alias("t"), ((F.col("id") * 7919) % 10**6).alias("i"))
    ranges = materialize(in_ranges(df, ["k", F.col("t").asc_nulls_first(), "i"], 10**6), "test-ranges")
    assert ranges.groupBy("k", "_range").count().agg(F.max("count")).first()[0] <= MOST_SORTED
    out = with_position(df, ["k"], "t", ["i"])
    assert out.filter(F.col("position") != F.col("i") + 1).count() == 0 and out.count() == 10**6


def test_positions_of_no_rows(spark):
    df = spark.createDataFrame([], "k string, t timestamp, i bigint")
    assert with_position(df, ["k"], "t", ["i"]).count() == 0


def test_extreme_rows_ties_and_null_times(spark):
    rows = [("a", T0, "r1", "x"), ("a", T0, "r2", "y"), ("b", T0, "r3", "z"), ("b", None, "r0", "w"), (None, T0, "r9", "n")]
    df = spark.createDataFrame(rows, "k string, t timestamp, id string, v string")
    last = extreme_rows(df, ["k"], "t", "id", ["v"], extra=[F.count(F.lit(1)).alias("n")])
    assert {(r.k, r.v, r.n) for r in last.collect()} == {("a", "y", 2), ("b", "w", 2)}
    first = extreme_rows(df, ["k"], "t", "id", ["v"], newest=False)
    assert {(r.k, r.v) for r in first.collect()} == {("a", "x"), ("b", "z")}


@pytest.mark.parametrize("most", [8, MOST_SORTED])
def test_rank_of_every_row(spark, monkeypatch, most):
    monkeypatch.setattr(ordering, "MOST_SORTED", most)
    rnd = random.Random(8)
    rows = [(rnd.choice([None, 1, 2, 2, 2, 50]), i) for i in range(120)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(5)
    got = {r.i: r["rank"] for r in with_rank(df, [F.col("v").desc_nulls_first(), F.col("i").asc()]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    assert [got[i] for _, i in want] == list(range(1, 121))
    assert with_rank(df.limit(0), [F.col("i").asc()]).count() == 0


def test_ranked_head(spark):
    got = ranked_head(spark.range(100), [F.col("id").desc()], 3).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in got] == [(99, 1), (98, 2), (97, 3)]


def test_tasks_follow_the_rows(spark, make_spans, monkeypatch):
    """With more rows than the session's partitions should sort, the rows are dealt to more tasks."""
    from tracegauge.operators import ordering, scoring

    monkeypatch.setattr(ordering, "MOST_SORTED", 40)
    rows = [{"record_type": "SPAN", "trace_id": f"t{i % 100}", "span_type": "s", "user_query": str(i), "start_ts": datetime.datetime(2024, 1, 1, 0, 0, i % 60)} for i in range(1000)]
    spans = make_spans(rows)
    placed = ordering.with_position(spans.select("trace_id", "start_ts", "user_query"), ["trace_id"], "start_ts", ["user_query"])
    assert placed.rdd.getNumPartitions() == 50 and placed.agg(F.sum("position")).first()[0] == 100 * 55
    documents = scoring.trace_documents(spans)
    assert documents.rdd.getNumPartitions() == 50 and documents.agg(F.sum("n_steps")).first()[0] == 1000
