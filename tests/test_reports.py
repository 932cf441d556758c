"""Edge rows, and the reduced plans against the joins they replace."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracegauge.functions.exprs import AgentPair
from tracegauge.operators import pairs
from tracegauge.operators.usage import logged_input_tokens, logged_usage
from tracegauge.plans import dashboard as dash
from tracegauge.plans import reports as rep

T0 = datetime.datetime(2024, 1, 1)
A, B = "AGENT_A", "AGENT_B"


def root(agent, query, record, ms, at=0, **more):
    return {
        "record_type": "SPAN",
        "agent_name": agent,
        "span_type": "record_root",
        "record_id": record,
        "user_query": query,
        "agent_output": f"out {record}",
        "trace_id": f"t-{record}",
        "duration_ms": ms,
        "start_ts": T0,
        "end_ts": None if at is None else T0 + datetime.timedelta(seconds=at),
        "has_score": False,
        **more,
    }


def evaluation(agent, record, metric, score, present=True):
    return {
        "record_type": "SPAN",
        "agent_name": agent,
        "span_type": "eval_root",
        "record_id": record,
        "target_record_id": record,
        "metric": metric,
        "score": score,
        "has_score": present,
    }


@pytest.fixture
def crowd(make_spans):
    """Random runs; one question and one record hold a third of all rows."""
    rnd = random.Random(5)
    rows = []
    for i in range(240):
        agent = A if i % 2 else B
        query = "hot" if i % 3 == 0 else f"q{rnd.randrange(6)}"
        rows.append(root(agent, query, f"r{i}", rnd.choice([0, 10, 10, rnd.randrange(1000)]), at=rnd.randrange(50)))
        for m in ("answer_correctness" if agent == A else "correctness", "coherence"):
            rows.append(evaluation(agent, f"r{i}", m, rnd.choice([1.0, 0.5, 0.25, None])))
        if agent == A and i % 4 == 1:
            rows.append({"record_type": "SPAN", "agent_name": A, "span_type": "generation", "record_id": f"r{i}", "tokens_in": i, "tokens_out": 2, "tokens_total": i + 2})
        if agent == B and i % 4 == 0:
            text = "x usage_metadata={'input_tokens': %d, 'output_tokens': 3, 'total_tokens': %d, 'ok': True} y" % (i, i + 3)
            rows.append({"record_type": "SPAN", "agent_name": B, "span_type": "graph_node", "record_id": f"r{i}", "call_return": text})
    rows += [evaluation(A, "r1", "coherence", rnd.choice([1.0, 0.5])) for _ in range(400)]
    rows.append(root(B, "hot", "r0", 77))
    return make_spans(rows).cache()


def test_scorecard_equals_the_full_pairing(crowd):
    e = crowd.filter((F.col("span_type") == "eval_root") & F.col("has_score")).select("agent_name", "metric", "score")
    lat = crowd.filter(F.col("span_type") == "record_root").select("agent_name", "duration_ms")
    naive = e.join(lat, "agent_name", "full_outer").groupBy("agent_name").agg(
        F.countDistinct("metric").alias("m"),
        F.round(F.avg("score"), 4).alias("a"),
        F.min("score").alias("mi"),
        F.countDistinct("duration_ms").alias("d"),
        F.round(F.avg("duration_ms"), 0).alias("l"),
        F.round(F.median("duration_ms"), 0).alias("md"),
        F.max("duration_ms").alias("mx"),
    )
    want = {r.agent_name: tuple(r)[1:] for r in naive.collect()}
    got = {
        r.agent_name: (r.num_eval_metrics, r.avg_eval_score, r.min_eval_score, r.num_invocations, r.avg_latency_ms, r.median_latency_ms, r.max_latency_ms)
        for r in rep.scorecard(crowd).collect()
    }
    assert got == want


def _responses(spans, side):
    agent = A if side == "a" else B
    usage = pairs.token_totals(pairs.side_usage(spans, AgentPair(), side))
    return pairs.roots_of(spans, agent).select("user_query", "record_id", "duration_ms").join(usage, "record_id", "left").toPandas()


def test_pair_averages_equal_the_pair_join(crowd):
    a, b = _responses(crowd, "a"), _responses(crowd, "b")
    p = a.merge(b, on="user_query", suffixes=("_a", "_b"))
    got = pairs.pair_averages(crowd).first()
    assert got.a_latency_ms == pytest.approx(p.duration_ms_a.mean(), abs=1e-3)
    assert got.latency_diff_ms == pytest.approx((p.duration_ms_a - p.duration_ms_b).mean(), abs=1e-3)
    for s in "ab":
        for c in pairs.TOKEN_COLUMNS:
            assert got[f"avg_{s}_{c}"] == pytest.approx(p[f"{c}_{s}"].mean(), abs=1e-3)


@pytest.mark.parametrize("top", [1, 2, 7, 40, 100000])
def test_widest_pairs_equal_the_sorted_pair_join(crowd, top):
    a, b = _responses(crowd, "a"), _responses(crowd, "b")
    p = a.merge(b, on="user_query", suffixes=("_a", "_b"))
    p["gap"] = (p.duration_ms_a - p.duration_ms_b).abs()
    p = p.sort_values(["gap", "user_query", "record_id_a", "record_id_b"], ascending=[False, True, True, True]).head(top)
    if top > 1000:
        got = pairs.widest_pairs(crowd, top=top).count()
        assert got == len(p)
        return
    got = [(r.user_query, r.a_record_id, r.b_record_id) for r in pairs.widest_pairs(crowd, top=top).orderBy("rank").collect()]
    assert got == list(zip(p.user_query, p.record_id_a, p.record_id_b))


def test_question_scores_equal_the_join(crowd):
    roots = crowd.filter(F.col("span_type") == "record_root").select("agent_name", "record_id", "user_query")
    evals = crowd.filter(F.col("span_type") == "eval_root").select("agent_name", F.col("target_record_id").alias("record_id"), "metric", "score")
    naive = roots.join(evals, ["agent_name", "record_id"]).groupBy("agent_name", "user_query", "metric").agg(F.avg("score").alias("s"))
    want = {(r.agent_name, r.user_query, r.metric): r.s for r in naive.collect()}
    got = {(r.agent_name, r.user_query, r.metric): r.avg_score for r in rep.ev.scores_by_question(crowd, F.col("metric")).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_null_agent_shares_one_row(make_spans):
    spans = make_spans([root(None, "q", "r1", 5), evaluation(None, "r1", "m", 0.5), root(A, "q", "r2", 7)])
    got = {r.agent_name: (r.avg_eval_score, r.num_requests) for r in rep.scorecard(spans, pair=None).collect()}
    assert got == {None: (0.5, 1), A: (None, 1)}


def test_distribution_edge_rows(make_spans):
    spans = make_spans([evaluation(A, "r1", "one", 0.4), evaluation(A, "r2", "nulls", None), evaluation(A, "r3", "nulls", None), evaluation(A, "r4", "absent", 0.9, present=False)])
    got = {r.metric: r for r in rep.score_distribution(spans).collect()}
    assert set(got) == {"one", "nulls"}
    assert got["one"].stddev_score is None and got["one"].median_score == 0.4
    assert (got["nulls"].num_evals, got["nulls"].avg_score, got["nulls"].perfect_score_pct) == (2, None, 0.0)


def test_buckets_of_null_and_large_scores(make_spans):
    spans = make_spans([evaluation(A, "r", "m", s) for s in (None, 1.0, 1.5, 0.8, 0.79, 0.4, 0.1)])
    got = {r.score_bucket: r["count"] for r in rep.score_buckets(spans).collect()}
    assert got == {"< 0.4 (Poor)": 2, "1.0 (Perfect)": 1, "0.8-0.99": 2, "0.6-0.79": 1, "0.4-0.59": 1}


def test_missing_side_ties_in_comparison_and_drops_out_of_deltas(make_spans):
    spans = make_spans([root(A, "q", "r1", 5), evaluation(A, "r1", "m", 0.5), root(B, "q", "r2", 5), evaluation(B, "r2", "other", 0.5)])
    got = {r.normalized_metric: (r.winner, r.a_n, r.b_n) for r in rep.metric_comparison(spans).collect()}
    assert got == {"m": ("TIE", 1, 0), "other": ("TIE", 0, 1)}
    assert rep.query_delta(spans).count() == 0 and rep.win_loss_tie(spans).count() == 0


def test_summary_edge_rows(make_spans):
    spans = make_spans(
        [
            root(A, "q", "r1", 10, at=5),
            root(A, "q", "r2", 20, at=None),
            root(B, "q", "r3", 7, at=1),
            root(B, "unscored", "r4", 7),
            root(A, None, "r5", 7),
            evaluation(A, "r1", "m", 0.125),
            evaluation(A, "r2", "m", 0.5),
            evaluation(A, "r5", "m", 0.5),
            evaluation(B, "r3", "m", None),
        ]
    )
    rows = rep.exec_summary(spans).collect()
    assert [r.user_query for r in rows] == ["q"]
    # A NULL time is the latest; 0.125 becomes 0.13 before the mean, 0.315 becomes 0.32 after it.
    assert (rows[0].a_output, rows[0].a_latency_ms, rows[0].a_eval_scores) == ("out r2", 15.0, '{"m":0.32}')
    assert rows[0].b_eval_scores == "{}"


def test_percent_of_zero_latency_is_null(make_spans):
    spans = make_spans([root(A, "q", "r1", 10), root(B, "q", "r2", 0)])
    assert pairs.widest_pairs(spans, top=1).first().latency_diff_pct is None


def test_usage_text(make_spans):
    def call(text):
        return {"agent_name": B, "span_type": "graph_node", "record_id": "r", "call_return": text}

    good = "usage_metadata={'input_tokens': 1, 'ok': True} usage_metadata={'input_tokens': 2}"
    spans = make_spans([call(good), call("usage_metadata={'input_tokens': 4, 'ok': False}"), call("usage_metadata={'input_tokens': 8, 'd': {'x': 1}}"), call("usage_metadata={}"), call(None)])
    assert sorted(r.tokens_in for r in logged_usage(spans, B).collect()) == [1, 2]
    assert sorted(r.tokens_in for r in logged_usage(spans, B, lenient=True).collect()) == [1, 2, 4]


def test_logged_input_tokens(spark):
    df = spark.createDataFrame([("a 'input_tokens': 12, 'input_tokens': 9",), ("none",), (None,)], "t string")
    assert [r.n for r in df.select(logged_input_tokens(F.col("t")).alias("n")).collect()] == [12, None, None]


def test_tool_rows_take_the_first_tool_and_duration(make_spans):
    base = {"record_type": "SPAN", "agent_name": A, "has_search": False, "has_analyst": False, "has_orchestration": False}
    spans = make_spans(
        [
            {**base, "has_search": True, "has_orchestration": True, "search_ms": None, "orchestration_ms": 9},
            {**base, "has_analyst": True, "analyst_ms": 5},
            base,
        ]
    )
    assert {(r.tool_type, r.avg_duration_ms) for r in rep.tool_breakdown(spans).collect()} == {("search", 9.0), ("analyst", 5.0)}


def test_timeline_of_one_trace(make_spans):
    steps = [
        {"record_type": "SPAN", "agent_name": A, "trace_id": "t", "start_ts": T0 + datetime.timedelta(seconds=s), "search_query": q, "analyst_sql": sql, "span_type": "x", "duration_ms": 1}
        for s, q, sql in ((2, "", "select 1"), (1, "find " + "y" * 200, None), (90, None, None))
    ]
    rows = dash.timeline_a(make_spans(steps), trace_id="t").orderBy("step_no").collect()
    assert [r.step_no for r in rows] == [1, 2, 3]
    assert len(rows[0].detail_preview) == 123 and rows[0].detail_preview.endswith("...")
    assert (rows[1].detail_preview, rows[1].detail_language, rows[2].detail_preview) == ("select 1", "sql", "")


def test_unknown_agent_has_no_label(make_spans):
    pair = AgentPair(a=A, b=B)
    spans = make_spans([root("other", "q", "r", 1)])
    assert dash.root_latency(spans, pair).count() == 0
    from tracegauge.functions.exprs import display_name

    row = spans.select(display_name(F.col("agent_name"), pair).alias("x"), display_name(F.col("agent_name"), pair, True).alias("y")).first()
    assert (row.x, row.y) == (None, "other")


def test_score_text_that_does_not_parse_counts_as_no_scores(spark):
    from tracegauge.plans.dashboard import per_query_from_text

    rows = [("q1", 1, 2, '{"coherence":0.5}', None), ("q2", 1, 2, "not json", "")]
    df = spark.createDataFrame(rows, "user_query string, a_latency_ms int, b_latency_ms int, a_eval_scores string, b_eval_scores string")
    got = per_query_from_text(df, ("coherence",)).collect()
    assert [(r.a_coherence, r.b_coherence) for r in got] == [(0.5, None), (None, None)]


def test_side_by_side_reads_the_spans_three_times(spark, make_spans, tmp_path):
    from tracegauge.operators.spans import read_spans, write_spans

    rows = [root(A, "q", "r1", 10), root(A, "q", "r1", 30), root(B, "q", "r2", 20), root(A, "only a", "r3", 1), root(B, "q", None, 40)]
    rows += [{"agent_name": A, "span_type": "generation", "record_id": "r1", "tokens_in": 4, "tokens_out": None, "tokens_total": 9}] * 2
    rows += [{"agent_name": A, "span_type": "generation", "record_id": None, "tokens_in": 1000}]
    rows += [{"agent_name": B, "span_type": "graph_node", "record_id": "r2", "call_return": "usage_metadata={'input_tokens': 7} usage_metadata={'input_tokens': 1}"}]
    write_spans(make_spans(rows), str(tmp_path / "s"))
    df = pairs.response_statistics(read_spans(spark, str(tmp_path / "s")))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 3
    (r,) = df.collect()
    assert (r.user_query, r.a_responses, r.b_responses, r.pairs) == ("q", 2, 2, 4)
    assert (r.a_latency_ms, r.b_latency_ms, r.latency_diff_ms) == (20.0, 30.0, -10.0)
    assert (r.a_prompt_tokens, r.a_completion_tokens, r.a_total_tokens, r.b_prompt_tokens) == (8.0, None, 18.0, 8.0)
