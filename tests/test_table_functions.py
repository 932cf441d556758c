"""Scans and reports asked in SQL."""

import pytest

from tracegauge.operators.spans import read_spans, write_spans
from tracegauge.plans.table_functions import register
from tracegauge.sources.attributes import SPAN_SCHEMA

A, B = "AGENT_A", "AGENT_B"


def root(agent, record, ms, query="q"):
    return {"agent_name": agent, "span_type": "record_root", "record_type": "SPAN", "record_id": record, "user_query": query, "duration_ms": ms}


def score(agent, record, value, metric="m"):
    return {"agent_name": agent, "span_type": "eval_root", "target_record_id": record, "metric": metric, "score": value, "has_score": True}


@pytest.fixture
def ask(spark, make_spans):
    def run(rows, text):
        register(spark, make_spans(rows), "t")
        return [tuple(r) for r in spark.sql(text).collect()]

    return run


def _filters(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]


def test_arguments_reach_the_partition_filters(spark, make_spans, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    write_spans(make_spans([root(a, f"r{i}", i) for i, a in enumerate([A, B, "C"])] + [score(A, "r0", 1.0), score(B, "r1", 0.5)]), str(tmp_path / "spans"))
    register(spark, read_spans(spark, str(tmp_path / "spans")), "p")
    scans = _filters(spark.sql(f"SELECT span_type, count(*) FROM p_agent_events('{A}') WHERE span_type = 'eval_root' GROUP BY 1"))
    assert scans and all(f"{A}" in s.split("PushedFilters")[0] and "eval_root" in s.split("PushedFilters")[0] for s in scans)
    for report in ("scorecard", "win_loss_tie", "latency_percentiles"):
        scans = _filters(spark.sql(f"SELECT * FROM p_{report}('{A}', '{B}')"))
        partition = [s.split("PartitionFilters:")[1].split("PushedFilters")[0] for s in scans]
        assert partition and all(A in x and B in x and ("record_root" in x or "eval_root" in x) for x in partition)
        assert all(len(s.split("ReadSchema:")[1].split(",")) < 8 for s in scans)
    assert spark.sql(f"SELECT count(*) FROM p_all_events('{A}', 'C')").first()[0] == 3
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_every_column_is_there(spark, make_spans):
    register(spark, make_spans([root(A, "r", 1)]), "t")
    assert spark.sql(f"SELECT * FROM t_agent_events('{A}')").columns == SPAN_SCHEMA.names


def test_optional_arguments(ask):
    rows = [{**root(A, "r", 1), "agent_type": "x"}, {**root(A, "s", 1), "agent_type": None}]
    assert len(ask(rows, f"SELECT * FROM t_agent_events('{A}')")) == 2
    assert len(ask(rows, f"SELECT * FROM t_agent_events('{A}', kind => 'x')")) == 1
    logs = [{"agent_name": A, "record_type": "LOG", "run_name": "run", "severity": s} for s in ("ERROR", "INFO", None)]
    assert len(ask(logs, f"SELECT * FROM t_logs('{A}', 'run')")) == 3
    assert len(ask(logs, f"SELECT * FROM t_logs('{A}', 'run', 'ERROR,WARN')")) == 1


@pytest.mark.parametrize("share, want", [(0.0, -1500.0), (0.5, 250.5), (0.9, 900.5), (1.0, 999_999_999_999.0)])
def test_quantiles_interpolate(ask, share, want):
    values = [-1500, -1, 0, 250, 251, 700, 900, 999_999_999_999, None]
    values = [-1500, 1, 250, 251, 900, 999_999_999_999] if share in (0.0, 0.5, 1.0) else [0, 0, 0, 0, 0, 0, 0, 0, 0, 900, 905]
    got = ask([root(A, str(i), v) for i, v in enumerate(values)], f"SELECT duration_ms FROM t_latency_quantile('{A}', '{B}', {share})")
    assert got == [(want if share != 0.9 else 900.0,)]


def test_one_side_is_missing(ask):
    rows = [root(A, "r", None), score(A, "r", None), score(B, "s", 0.25)]
    got = sorted(ask(rows, f"SELECT agent_name, num_eval_metrics, avg_eval_score, num_invocations, num_requests, median_latency_ms FROM t_scorecard('{A}', '{B}')"))
    assert got == [(A, 1, None, 0, 1, None), (B, 1, 0.25, 0, 0, None)]
    assert ask(rows, f"SELECT * FROM t_win_loss_tie('{A}', '{B}')") == []
    assert ask([], f"SELECT * FROM t_scorecard('{A}', '{B}')") == []


def test_registering_again_keeps_earlier_results(spark, make_spans):
    register(spark, make_spans([root(A, "r", 1)]), "t")
    old = spark.sql(f"SELECT count(*) FROM t_agent_events('{A}')")
    register(spark, make_spans([root(A, "r", 1), root(A, "s", 1)]), "t")
    assert (old.first()[0], spark.sql(f"SELECT count(*) FROM t_agent_events('{A}')").first()[0]) == (1, 2)


def test_some_functions_over_some_columns(spark, make_spans):
    few = make_spans([root(A, "r0", 1), root(B, "r1", 2), score(A, "r0", 1.0), score(B, "r1", 0.5)]).select(
        "agent_name", "span_type", "record_id", "user_query", "metric", "score", "target_record_id", "has_score"
    )
    made = register(spark, few, "few", only=("query_delta",))
    assert set(made) == {"few_query_delta", "few_requests", "few_scores", "few_all_events"}
    assert [tuple(r) for r in spark.sql(f"SELECT user_query, metric, delta FROM few_query_delta('{A}', '{B}')").collect()] == [("q", "m", 0.5)]
