"""The numbered comparison reports. Every function takes typed spans and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.functions.exprs import (
    REPORT_BUCKETS,
    AgentPair,
    BucketLabels,
    canonical_metric,
    replaced_metric,
    round_half,
    score_bucket,
    share_pct,
    winner,
)
from tracegauge.operators import evaluations as ev
from tracegauge.operators.ordering import extreme_rows
from tracegauge.operators.profile import value_profile
from tracegauge.operators.usage import logged_input_tokens

PAIR = AgentPair()
SPAN_TYPES_IN_TOTALS = ("retrieval", "tool", "graph_node", "MCP", "generation", "record_root", "unknown")


def _agents(pair: AgentPair | None) -> tuple[str, str] | None:
    """The agents to scan; without a pair every row counts, also one without an agent name."""
    return None if pair is None else (pair.a, pair.b)


def _ms(name: str):
    return round_half(F.col(name), 0)


def scorecard(spans: DataFrame, pair: AgentPair | None = PAIR, digits: int = 4) -> DataFrame:
    """Report 1. Scores and latencies are reduced per agent before they meet; pairing every score
    with every latency first gives the same averages, extremes, median and distinct counts.
    ``num_invocations`` counts distinct latencies; ``num_requests`` counts requests."""
    both = ev.both_agents(spans, _agents(pair))
    scores = (
        ev.scored(both)
        .groupBy("agent_name", "metric")
        .agg(F.sum("score").alias("_s"), F.count("score").alias("_n"), F.min("score").alias("_min"))
        .groupBy("agent_name")
        .agg(
            F.count("metric").alias("num_eval_metrics"),
            (F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0)).cast("double")).alias("_avg"),
            F.min("_min").alias("_min"),
        )
    )
    lat = value_profile(ev.roots(both), ["agent_name"], "duration_ms", {"_p50": 0.5}).withColumnRenamed("agent_name", "_agent")
    joined = scores.join(lat, scores.agent_name.eqNullSafe(lat["_agent"]), "full_outer")
    return joined.select(
        F.coalesce("agent_name", "_agent").alias("agent_name"),
        F.coalesce("num_eval_metrics", F.lit(0)).alias("num_eval_metrics"),
        round_half(F.col("_avg"), digits).alias("avg_eval_score"),
        round_half(F.col("_min"), digits).alias("min_eval_score"),
        F.coalesce("n_distinct", F.lit(0)).alias("num_invocations"),
        F.coalesce("n_rows", F.lit(0)).alias("num_requests"),
        round_half(F.col("v_sum") / F.nullif(F.col("n_values"), F.lit(0)), 0).alias("avg_latency_ms"),
        _ms("_p50").alias("median_latency_ms"),
        _ms("v_max").alias("max_latency_ms"),
    ).orderBy(F.col("agent_name").asc_nulls_last())


def score_distribution(spans: DataFrame, pair: AgentPair | None = PAIR) -> DataFrame:
    """Report 2."""
    s = F.col("score")
    p = value_profile(
        ev.scored(ev.both_agents(spans, _agents(pair))),
        ["agent_name", "metric"],
        "score",
        {"_p50": 0.5},
        sums={"_perfect": F.when(s == 1, 1).otherwise(0)},
    )
    n = F.col("n_values")
    return p.select(
        "agent_name",
        "metric",
        F.col("n_rows").alias("num_evals"),
        round_half(F.col("v_sum") / F.nullif(n, F.lit(0)), 4).alias("avg_score"),
        round_half(F.col("_p50"), 4).alias("median_score"),
        round_half(F.col("v_min"), 4).alias("min_score"),
        round_half(F.col("v_max"), 4).alias("max_score"),
        round_half(F.when(n > 1, F.sqrt(F.col("v_m2") / F.nullif(n - 1, F.lit(0)))), 4).alias("stddev_score"),
        F.col("_perfect").cast("bigint").alias("perfect_score_count"),
        share_pct(F.col("_perfect"), F.col("n_rows")).alias("perfect_score_pct"),
    ).orderBy("agent_name", "metric")


def latency_percentiles(spans: DataFrame, pair: AgentPair | None = PAIR) -> DataFrame:
    """Report 3."""
    p = value_profile(
        ev.roots(ev.both_agents(spans, _agents(pair))),
        ["agent_name"],
        "duration_ms",
        {"_p50": 0.5, "_p90": 0.9, "_p95": 0.95},
    )
    return p.select(
        "agent_name",
        F.col("n_rows").alias("num_requests"),
        round_half(F.col("v_sum") / F.nullif(F.col("n_values"), F.lit(0)), 0).alias("avg_ms"),
        _ms("_p50").alias("p50_ms"),
        _ms("_p90").alias("p90_ms"),
        _ms("_p95").alias("p95_ms"),
        _ms("v_min").alias("min_ms"),
        _ms("v_max").alias("max_ms"),
    ).orderBy("agent_name")


def span_breakdown(spans: DataFrame, pair: AgentPair | None = PAIR) -> DataFrame:
    """Report 4."""
    rows = ev.both_agents(spans, _agents(pair)).filter((F.col("record_type") == "SPAN") & F.col("span_type").isNotNull())
    p = value_profile(rows, ["agent_name", "span_type"], "duration_ms", {"_p50": 0.5})
    return p.select(
        "agent_name",
        "span_type",
        F.col("n_rows").alias("span_count"),
        round_half(F.col("v_sum") / F.nullif(F.col("n_values"), F.lit(0)), 0).alias("avg_duration_ms"),
        _ms("_p50").alias("median_duration_ms"),
        _ms("v_max").alias("max_duration_ms"),
    ).orderBy("agent_name", F.col("avg_duration_ms").desc_nulls_first(), "span_type")


def _tool_rows(spans: DataFrame, agent: str) -> DataFrame:
    return spans.filter(
        (F.col("agent_name") == agent)
        & (F.col("record_type") == "SPAN")
        & (F.col("has_search") | F.col("has_analyst") | F.col("has_orchestration"))
    )


def tool_breakdown(spans: DataFrame, pair: AgentPair = PAIR, labels: tuple[str, str, str] = ("search", "analyst", "orchestration")) -> DataFrame:
    """Report 5. A row counts for the first tool it names and takes the first duration it has."""
    tool = F.when(F.col("has_search"), labels[0]).when(F.col("has_analyst"), labels[1]).when(F.col("has_orchestration"), labels[2])
    took = F.coalesce("search_ms", "analyst_ms", "orchestration_ms")
    return (
        _tool_rows(spans, pair.a)
        .groupBy(tool.alias("tool_type"))
        .agg(F.count(F.lit(1)).alias("invocations"), F.avg(took).alias("_avg"), F.max(took).alias("_max"))
        .select(
            F.lit(pair.a).alias("agent_name"),
            "tool_type",
            "invocations",
            _ms("_avg").alias("avg_duration_ms"),
            _ms("_max").alias("max_duration_ms"),
        )
        .orderBy(F.col("avg_duration_ms").desc_nulls_first(), "tool_type")
    )


def agent_span_totals(spans: DataFrame, pair: AgentPair = PAIR, span_types: tuple[str, ...] = SPAN_TYPES_IN_TOTALS) -> DataFrame:
    """Report 6."""
    rows = spans.filter(
        (F.col("agent_name") == pair.b) & (F.col("record_type") == "SPAN") & F.col("span_type").isin(*span_types)
    )
    return (
        rows.groupBy("span_type")
        .agg(
            F.count(F.lit(1)).alias("span_count"),
            F.avg("duration_ms").alias("_avg"),
            F.max("duration_ms").alias("_max"),
            F.sum("duration_ms").alias("_sum"),
        )
        .select(
            F.lit(pair.b).alias("agent_name"),
            "span_type",
            "span_count",
            _ms("_avg").alias("avg_duration_ms"),
            _ms("_max").alias("max_duration_ms"),
            _ms("_sum").alias("total_duration_ms"),
        )
        .orderBy(F.col("avg_duration_ms").desc_nulls_first(), "span_type")
    )


def root_input_tokens(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """Unnumbered report: the input tokens found in each root's call log, then every column."""
    rows = spans.filter((F.col("agent_name") == pair.b) & (F.col("span_type") == "record_root"))
    return rows.select(logged_input_tokens(F.col("call_return")).alias("input_tokens"), "*")


def score_buckets(spans: DataFrame, pair: AgentPair | None = PAIR, labels: BucketLabels = REPORT_BUCKETS) -> DataFrame:
    """Report 8."""
    return (
        ev.scored(ev.both_agents(spans, _agents(pair)))
        .groupBy("agent_name", "metric", score_bucket(F.col("score"), labels).alias("score_bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("agent_name", "metric", "score_bucket")
    )


def run_comparison(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """Report 9."""
    return (
        ev.scored(spans.filter(F.col("agent_name") == pair.b))
        .groupBy("run_name", "metric")
        .agg(
            F.count(F.lit(1)).alias("num_evals"),
            round_half(F.avg("score"), 4).alias("avg_score"),
            round_half(F.min("score"), 4).alias("min_score"),
            F.count_if(F.col("score") == 1).alias("perfect_count"),
        )
        .orderBy("run_name", "metric")
    )


def question_sides(spans: DataFrame, pair: AgentPair = PAIR, dashboard: bool = False) -> DataFrame:
    """One row per question that has a score on at least one side: latest output, latest trace, mean
    latency and metric -> score map of both agents.

    Latest row and mean latency come from aggregations, both sides from conditional aggregates over
    (question, agent) rows. No window or self-join sees a whole question.
    A NULL question matches no score and so has no row.
    """
    both = ev.both_agents(spans, _agents(pair))
    metric = replaced_metric(F.col("metric")) if dashboard else F.col("metric")
    two_digits = F.round(F.col("score").cast("decimal(28,9)"), 2)
    per_metric = ev.scores_by_question(both, metric, two_digits).select(
        "agent_name", "user_query", "metric", F.round(F.col("avg_score").cast("decimal(28,9)"), 2).cast("decimal(5,2)").alias("avg_score")
    )
    known = F.col("metric").isNotNull() & F.col("avg_score").isNotNull()
    maps = per_metric.groupBy("agent_name", "user_query").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(known, F.struct("metric", "avg_score"))))).alias("scores")
    )
    latest = extreme_rows(
        ev.roots(both),
        ["agent_name", "user_query"],
        "end_ts",
        "record_id",
        ["agent_output", "trace_id"],
        extra=[F.avg("duration_ms").alias("_mean")],
    ).withColumn("latency_ms", round_half(F.col("_mean"), 0))
    sides = latest.join(maps, ["agent_name", "user_query"], "left")
    cells = ["agent_output", "trace_id", "latency_ms", "scores"]
    return (
        sides.groupBy("user_query")
        .agg(
            *[
                F.max_by(F.when(F.col("agent_name") == agent, F.col(c)), F.col("agent_name") == agent).alias(f"{s}_{c}")
                for s, agent in (("a", pair.a), ("b", pair.b))
                for c in cells
            ]
        )
        .filter(F.col("a_scores").isNotNull() | F.col("b_scores").isNotNull())
    )


def exec_summary(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """Report 10; the score maps are printed as JSON text with sorted keys."""
    return (
        question_sides(spans, pair)
        .select(
            "user_query",
            F.col("a_agent_output").alias("a_output"),
            F.col("b_agent_output").alias("b_output"),
            "a_latency_ms",
            "b_latency_ms",
            F.to_json("a_scores").alias("a_eval_scores"),
            F.to_json("b_scores").alias("b_eval_scores"),
        )
        .orderBy(F.col("user_query").asc_nulls_last())
    )


def metric_comparison(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """Report 11."""
    is_a, is_b = F.col("agent_name") == pair.a, F.col("agent_name") == pair.b
    return (
        ev.scored(ev.both_agents(spans, _agents(pair)))
        .groupBy(canonical_metric(F.col("metric")).alias("normalized_metric"))
        .agg(
            F.avg(F.when(is_a, F.col("score"))).alias("_a"),
            F.avg(F.when(is_b, F.col("score"))).alias("_b"),
            F.count_if(is_a).alias("a_n"),
            F.count_if(is_b).alias("b_n"),
        )
        .select(
            "normalized_metric",
            round_half(F.col("_a"), 4).alias("a_avg"),
            round_half(F.col("_b"), 4).alias("b_avg"),
            round_half(F.col("_a") - F.col("_b"), 4).alias("delta"),
            winner(F.col("_a"), F.col("_b"), pair.label_a, pair.label_b).alias("winner"),
            "a_n",
            "b_n",
        )
        .orderBy("normalized_metric")
    )


def question_deltas(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """(question, metric) rows that both agents have a score for, unrounded."""
    joined = ev.scores_by_question(ev.both_agents(spans, _agents(pair)), canonical_metric(F.col("metric")))
    return (
        joined.groupBy("user_query", "metric")
        .agg(
            F.max(F.when(F.col("agent_name") == pair.a, F.col("avg_score"))).alias("a_raw"),
            F.max(F.when(F.col("agent_name") == pair.b, F.col("avg_score"))).alias("b_raw"),
        )
        .filter(F.col("a_raw").isNotNull() & F.col("b_raw").isNotNull())
    )


def query_delta(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """Report 12."""
    return (
        question_deltas(spans, pair)
        .select(
            "user_query",
            "metric",
            round_half(F.col("a_raw"), 3).alias("a_score"),
            round_half(F.col("b_raw"), 3).alias("b_score"),
            round_half(F.col("a_raw") - F.col("b_raw"), 3).alias("delta"),
            winner(F.col("a_raw"), F.col("b_raw"), pair.label_a, pair.label_b).alias("winner"),
        )
        .orderBy("metric", F.col("delta").desc_nulls_first(), "user_query")
    )


def win_loss_tie(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """Report 13."""
    verdict = winner(F.col("a_raw"), F.col("b_raw"), "A_WIN", "B_WIN")
    return (
        question_deltas(spans, pair)
        .select("metric", verdict.alias("outcome"))
        .groupBy("metric")
        .agg(
            F.count_if(F.col("outcome") == "A_WIN").alias("a_wins"),
            F.count_if(F.col("outcome") == "B_WIN").alias("b_wins"),
            F.count_if(F.col("outcome") == "TIE").alias("ties"),
            F.count(F.lit(1)).alias("total_queries"),
        )
        .orderBy("metric")
    )
