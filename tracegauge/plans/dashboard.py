"""Dashboard frames: the report queries with display names, plus what a viewer derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.functions.exprs import (
    DASHBOARD_BUCKETS,
    AgentPair,
    display_name,
    first_text,
    looks_like_sql,
    preview,
    replaced_metric,
    round_half,
    score_bucket,
    share_pct,
)
from tracegauge.operators import evaluations as ev
from tracegauge.operators.ordering import with_position
from tracegauge.operators.profile import value_profile
from tracegauge.plans.reports import PAIR, question_sides, scorecard, tool_breakdown

EVALUATION_SPANS = ("eval", "eval_root")
KNOWN_METRICS = ("coherence", "correctness", "groundedness", "logical_consistency")


def exec_with_traces(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """Report 10 with trace ids; aliases of a metric name are merged before averaging."""
    return (
        question_sides(spans, pair, dashboard=True)
        .select(
            "user_query",
            "a_latency_ms",
            "b_latency_ms",
            F.to_json("a_scores").alias("a_eval_scores"),
            F.to_json("b_scores").alias("b_eval_scores"),
            F.col("a_agent_output").alias("a_output"),
            F.col("b_agent_output").alias("b_output"),
            "a_trace_id",
            "b_trace_id",
        )
        .orderBy(F.col("user_query").asc_nulls_last())
    )


def scorecard_short(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    return scorecard(spans, pair, digits=3).select(
        display_name(F.col("agent_name"), pair, keep_unknown=True).alias("label"),
        "agent_name",
        "avg_eval_score",
        "min_eval_score",
        "avg_latency_ms",
        "median_latency_ms",
        "num_invocations",
    )


def per_query_wide(spans: DataFrame, pair: AgentPair = PAIR, metrics: tuple[str, ...] = KNOWN_METRICS) -> DataFrame:
    """One column per agent and metric; a metric without a score stays NULL."""
    sides = question_sides(spans, pair, dashboard=True)
    cells = [
        F.try_element_at(F.col(f"{s}_scores"), F.lit(m)).cast("double").alias(f"{s}_{m}") for s in "ab" for m in metrics
    ]
    return sides.select("user_query", "a_latency_ms", "b_latency_ms", *cells).orderBy("user_query")


def per_query_from_text(rows: DataFrame, metrics: tuple[str, ...] = KNOWN_METRICS) -> DataFrame:
    """The same from rows whose scores are JSON text, as ``exec_with_traces`` gives them. Missing text
    and text that does not parse count as no scores."""
    read = lambda s: F.from_json(f"{s}_eval_scores", "map<string,double>")
    cells = [F.try_element_at(read(s), F.lit(m)).alias(f"{s}_{m}") for s in "ab" for m in metrics]
    return rows.select("user_query", "a_latency_ms", "b_latency_ms", *cells).orderBy("user_query")


def metric_detail(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    rows = ev.scored(ev.both_agents(spans, (pair.a, pair.b))).select(
        "agent_name", replaced_metric(F.col("metric")).alias("metric"), "score"
    )
    p = value_profile(
        rows,
        ["agent_name", "metric"],
        "score",
        {"_p50": 0.5},
        sums={"_perfect": F.when(F.col("score") == 1, 1).otherwise(0)},
    )
    return p.select(
        display_name(F.col("agent_name"), pair).alias("agent"),
        "metric",
        round_half(F.col("v_sum") / F.nullif(F.col("n_values"), F.lit(0)), 3).alias("avg_score"),
        round_half(F.col("_p50"), 3).alias("median_score"),
        round_half(F.col("v_min"), 3).alias("min_score"),
        F.col("n_rows").alias("num_evals"),
        share_pct(F.col("_perfect"), F.col("n_rows")).alias("perfect_pct"),
    ).orderBy("agent", "metric")


def bucket_facets(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """Bucket counts with a facet text; ``bucket_order`` is the position of the label, best first."""
    labels = DASHBOARD_BUCKETS.in_order()
    counts = (
        ev.scored(ev.both_agents(spans, (pair.a, pair.b)))
        .groupBy(
            "agent_name",
            replaced_metric(F.col("metric")).alias("metric"),
            score_bucket(F.col("score"), DASHBOARD_BUCKETS).alias("score_bucket"),
        )
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    label = display_name(F.col("agent_name"), pair)
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("score_bucket"))
    return counts.select(
        label.alias("label"),
        "metric",
        # A missing label or metric leaves the facet empty, as text concatenation does.
        F.concat(label, F.lit(" / "), F.col("metric")).alias("facet"),
        "score_bucket",
        order.cast("int").alias("bucket_order"),
        "cnt",
    ).orderBy("facet", "bucket_order")


def root_latency(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    return ev.roots(ev.both_agents(spans, (pair.a, pair.b))).select(
        "agent_name",
        display_name(F.col("agent_name"), pair).alias("label"),
        "user_query",
        F.col("duration_ms").alias("latency_ms"),
    )


def latency_box(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """Box-plot figures per agent: extremes, quartiles and median."""
    p = value_profile(
        ev.roots(ev.both_agents(spans, (pair.a, pair.b))),
        ["agent_name"],
        "duration_ms",
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
    )
    return p.select(
        display_name(F.col("agent_name"), pair).alias("label"),
        F.col("v_min").cast("double").alias("low"),
        *[round_half(F.col(c), 2).alias(c) for c in ("q1", "median", "q3")],
        F.col("v_max").cast("double").alias("high"),
    ).orderBy("label")


def query_latency_mean(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    return (
        root_latency(spans, pair)
        .dropna(subset=["user_query", "label"])
        .groupBy("user_query", "label")
        .agg(round_half(F.avg("latency_ms"), 4).alias("latency_ms"))
        .orderBy("user_query", "label")
    )


def span_breakdown_exec(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    """Report 4 without evaluation spans and without the median, ranked by mean duration per agent."""
    rows = ev.both_agents(spans, (pair.a, pair.b)).filter(
        (F.col("record_type") == "SPAN") & ~F.col("span_type").isin(*EVALUATION_SPANS)
    )
    return (
        rows.groupBy("agent_name", "span_type")
        .agg(F.count(F.lit(1)).alias("span_count"), F.avg("duration_ms").alias("_avg"), F.max("duration_ms").alias("_max"))
        .select(
            display_name(F.col("agent_name"), pair).alias("label"),
            "span_type",
            "span_count",
            round_half(F.col("_avg"), 0).alias("avg_duration_ms"),
            round_half(F.col("_max"), 0).alias("max_duration_ms"),
        )
        .orderBy("label", F.col("avg_duration_ms").asc_nulls_last(), "span_type")
    )


def tool_durations(spans: DataFrame, pair: AgentPair = PAIR) -> DataFrame:
    return tool_breakdown(spans, pair, ("Case Search", "Analyst", "Agent Orchestration")).select(
        F.col("tool_type").alias("tool"),
        F.col("invocations").alias("calls"),
        F.col("avg_duration_ms").alias("avg_ms"),
        F.col("max_duration_ms").alias("max_ms"),
    )


def _timeline_rows(spans: DataFrame, agent: str, trace_id: str | None) -> DataFrame:
    rows = spans.filter((F.col("agent_name") == agent) & (F.col("record_type") == "SPAN") & F.col("trace_id").isNotNull())
    return rows if trace_id is None else rows.filter(F.col("trace_id") == trace_id)


def _all_shown(rows: DataFrame) -> list[Column]:
    """An order by every shown column: rows that it leaves tied look the same."""
    return [F.col(c).asc_nulls_first() for c in ("step", "duration_ms", *sorted(set(rows.columns) - {"trace_id", "step", "duration_ms", "start_ts"}))]


def timeline_a(spans: DataFrame, pair: AgentPair = PAIR, trace_id: str | None = None) -> DataFrame:
    """Steps of agent A's traces in start order; all traces, or the one given."""
    rows = _timeline_rows(spans, pair.a, trace_id).select(
        "trace_id",
        F.coalesce("search_name", "analyst_model", "span_type", F.lit("orchestration")).alias("step"),
        "search_query",
        F.col("analyst_sql"),
        F.col("search_status").alias("status"),
        "duration_ms",
        "start_ts",
    )
    detail = first_text(F.col("search_query"), F.col("analyst_sql"))
    return with_position(rows, ["trace_id"], "start_ts", _all_shown(rows), "step_no").select(
        "trace_id",
        "step_no",
        "step",
        "search_query",
        "analyst_sql",
        "status",
        "duration_ms",
        preview(detail, 120).alias("detail_preview"),
        F.when(looks_like_sql(detail), "sql").otherwise("text").alias("detail_language"),
    )


def timeline_b(spans: DataFrame, pair: AgentPair = PAIR, trace_id: str | None = None) -> DataFrame:
    """Steps of agent B's traces in start order, evaluation spans left out."""
    rows = _timeline_rows(spans, pair.b, trace_id).filter(~F.col("span_type").isin(*EVALUATION_SPANS))
    rows = rows.select(
        "trace_id",
        F.coalesce("span_type", "call_function", F.lit("step")).alias("step"),
        "retrieval_query",
        F.col("call_function").alias("function_call"),
        F.left("call_return", F.lit(500)).alias("call_return"),
        "duration_ms",
        "start_ts",
    )
    return with_position(rows, ["trace_id"], "start_ts", _all_shown(rows), "step_no").select(
        "trace_id",
        "step_no",
        "step",
        "retrieval_query",
        "function_call",
        "call_return",
        "duration_ms",
        first_text(F.col("retrieval_query"), F.col("function_call")).alias("detail"),
        F.left(first_text(F.col("call_return")), F.lit(300)).alias("return_preview"),
    )
