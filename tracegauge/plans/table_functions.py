"""Scans and reports as SQL table functions.

``register(spark, spans)`` creates temporary functions whose arguments are literals, so that everything can be
asked in plain SQL: ``SELECT * FROM traces_win_loss_tie('AGENT_A', 'AGENT_B')``. A function is SQL text that Spark
inlines where it is called: its arguments become constants, filters around the call and inside it reach the
scan of the span table and prune its folders, and only the columns asked for are read.

The functions of a registration start with its name, so several span tables can be registered side by side.
Reports have the columns and the definitions of their counterparts in ``plans.reports``. Percentiles are exact and
no group is sorted as a whole: durations are counted by value, the counts by second decide which seconds hold the
wanted ranks, and only the values of these seconds are put in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tracegauge.functions.exprs import FLOAT_NOISE, METRIC_ALIASES, REPORT_BUCKETS
from tracegauge.plans.reports import SPAN_TYPES_IN_TOTALS


@dataclass(frozen=True)
class TableFunction:
    """``arguments`` and ``returns`` are SQL column lists; None returns every span column. In ``body``, {p} stands for the
    name of the registration."""

    name: str
    arguments: str
    body: str
    returns: str | None = None


def _round(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,9)), {digits}) AS DOUBLE)"


def _named(column: str) -> str:
    out = column
    for name, target in METRIC_ALIASES.items():
        out = f"CASE WHEN {column} = '{name}' THEN '{target}' ELSE {out} END"
    return out


def _winner(a: str, b: str, label_a: str, label_b: str) -> str:
    return f"CASE WHEN {a} - {b} > {FLOAT_NOISE} THEN {label_a} WHEN {a} - {b} < -{FLOAT_NOISE} THEN {label_b} ELSE 'TIE' END"


_BOTH = "agent STRING, other_agent STRING"
_TYPES = ", ".join(f"'{t}'" for t in SPAN_TYPES_IN_TOTALS)
_B = REPORT_BUCKETS

SCANS = (
    TableFunction(
        "agent_events",
        "agent STRING, kind STRING DEFAULT NULL",
        "SELECT * FROM {p}_spans WHERE agent_name = agent AND (kind IS NULL OR agent_type = kind)",
    ),
    TableFunction("all_events", _BOTH, "SELECT * FROM {p}_spans WHERE agent_name IN (agent, other_agent)"),
    TableFunction("run_events", "run STRING", "SELECT * FROM {p}_spans WHERE run_name = run"),
    TableFunction("record_events", "record STRING", "SELECT * FROM {p}_spans WHERE record_id = record"),
    TableFunction("requests", _BOTH, "SELECT * FROM {p}_all_events(agent, other_agent) WHERE span_type = 'record_root'"),
    TableFunction("scores", _BOTH, "SELECT * FROM {p}_all_events(agent, other_agent) WHERE span_type = 'eval_root' AND has_score"),
    TableFunction(
        "logs",
        "agent STRING, run STRING, levels STRING DEFAULT NULL",
        """SELECT * FROM {p}_spans WHERE agent_name = agent AND record_type = 'LOG' AND run_name = run
           AND (levels IS NULL OR array_contains(split(levels, ' *, *'), severity))""",
    ),
    TableFunction(
        "eval_run",
        "agent STRING, run STRING, newest INT DEFAULT 50",
        """SELECT * FROM (
             SELECT CAST(row_number() OVER (ORDER BY end_ts DESC NULLS FIRST, record_id, metric, start_ts) AS BIGINT) AS rank,
                    record_id, metric, score, target_record_id
             FROM {p}_spans WHERE agent_name = agent AND run_name = run AND span_type = 'eval_root')
           WHERE rank <= newest""",
        "rank BIGINT, record_id STRING, metric STRING, score DOUBLE, target_record_id STRING",
    ),
)

_SIDES = f"""
asked AS (SELECT agent_name, record_id, user_query, count(*) AS times FROM {{p}}_requests(agent, other_agent) GROUP BY ALL),
judged AS (
  SELECT agent_name, target_record_id AS record_id, {_named("metric")} AS metric, sum(score) AS total, count(score) AS n
  FROM {{p}}_scores(agent, other_agent) GROUP BY ALL),
answers AS (
  SELECT agent_name, user_query, metric, sum(total * times) / nullif(sum(n * times), 0) AS value
  FROM asked JOIN judged USING (agent_name, record_id) GROUP BY ALL),
sides AS (
  SELECT user_query, metric, max(CASE WHEN is_a THEN value END) AS a, max(CASE WHEN is_b THEN value END) AS b
  FROM (SELECT *, agent_name = agent AS is_a, agent_name = other_agent AS is_b FROM answers) GROUP BY user_query, metric),
pairs AS (SELECT * FROM sides WHERE a IS NOT NULL AND b IS NOT NULL)"""

REPORTS = (
    TableFunction(
        "request_counts",
        _BOTH,
        "SELECT agent_name, duration_ms, count(*) FROM {p}_requests(agent, other_agent) GROUP BY agent_name, duration_ms",
        "agent_name STRING, duration_ms BIGINT, n BIGINT",
    ),
    TableFunction(
        "latency_quantile",
        _BOTH + ", share DOUBLE",
        """WITH counts AS (SELECT *, floor(duration_ms / 1000) AS zone FROM {p}_request_counts(agent, other_agent) WHERE duration_ms IS NOT NULL),
           zones AS (SELECT agent_name, zone, sum(n) AS n FROM counts GROUP BY agent_name, zone),
           edges AS (SELECT agent_name, zone, n, sum(n) OVER (PARTITION BY agent_name ORDER BY zone) - n AS before,
                            share * (sum(n) OVER (PARTITION BY agent_name) - 1) AS place FROM zones),
           opened AS (SELECT * FROM edges WHERE before <= ceil(place) AND before + n > floor(place)),
           ranked AS (
             SELECT c.agent_name, c.duration_ms, o.place, c.n,
                    o.before + sum(c.n) OVER (PARTITION BY c.agent_name, c.zone ORDER BY c.duration_ms) - c.n AS first
             FROM counts c JOIN opened o ON c.agent_name <=> o.agent_name AND c.zone = o.zone),
           found AS (
             SELECT agent_name, max(place) AS place,
                    max(CASE WHEN first <= floor(place) AND floor(place) < first + n THEN duration_ms END) AS low,
                    max(CASE WHEN first <= ceil(place) AND ceil(place) < first + n THEN duration_ms END) AS high
             FROM ranked GROUP BY agent_name)
           SELECT agent_name, low + (place - floor(place)) * (high - low) FROM found""",
        "agent_name STRING, duration_ms DOUBLE",
    ),
    TableFunction(
        "scorecard",
        _BOTH,
        f"""WITH judged AS (
              SELECT agent_name, count(DISTINCT metric) AS num_eval_metrics, avg(score) AS mean, min(score) AS least
              FROM {{p}}_scores(agent, other_agent) GROUP BY agent_name),
            counted AS (
              SELECT agent_name, count(duration_ms) AS num_invocations, sum(n) AS num_requests, max(duration_ms) AS most,
                     sum(duration_ms * n) / nullif(sum(CASE WHEN duration_ms IS NOT NULL THEN n END), 0) AS mean
              FROM {{p}}_request_counts(agent, other_agent) GROUP BY agent_name)
            SELECT coalesce(j.agent_name, c.agent_name), coalesce(num_eval_metrics, 0), {_round("j.mean", 4)}, {_round("j.least", 4)},
                   coalesce(num_invocations, 0), coalesce(num_requests, 0), {_round("c.mean", 0)}, {_round("q.duration_ms", 0)}, {_round("c.most", 0)}
            FROM judged j FULL JOIN counted c ON j.agent_name <=> c.agent_name
            LEFT JOIN {{p}}_latency_quantile(agent, other_agent, 0.5) q ON c.agent_name <=> q.agent_name""",
        """agent_name STRING, num_eval_metrics BIGINT, avg_eval_score DOUBLE, min_eval_score DOUBLE, num_invocations BIGINT,
           num_requests BIGINT, avg_latency_ms DOUBLE, median_latency_ms DOUBLE, max_latency_ms DOUBLE""",
    ),
    TableFunction(
        "latency_percentiles",
        _BOTH,
        f"""WITH counted AS (
              SELECT agent_name, sum(n) AS num_requests, min(duration_ms) AS least, max(duration_ms) AS most,
                     sum(duration_ms * n) / nullif(sum(CASE WHEN duration_ms IS NOT NULL THEN n END), 0) AS mean
              FROM {{p}}_request_counts(agent, other_agent) GROUP BY agent_name)
            SELECT c.agent_name, num_requests, {_round("mean", 0)}, {_round("p50.duration_ms", 0)}, {_round("p90.duration_ms", 0)},
                   {_round("p95.duration_ms", 0)}, {_round("least", 0)}, {_round("most", 0)}
            FROM counted c
            LEFT JOIN {{p}}_latency_quantile(agent, other_agent, 0.5) p50 ON c.agent_name <=> p50.agent_name
            LEFT JOIN {{p}}_latency_quantile(agent, other_agent, 0.9) p90 ON c.agent_name <=> p90.agent_name
            LEFT JOIN {{p}}_latency_quantile(agent, other_agent, 0.95) p95 ON c.agent_name <=> p95.agent_name""",
        "agent_name STRING, num_requests BIGINT, avg_ms DOUBLE, p50_ms DOUBLE, p90_ms DOUBLE, p95_ms DOUBLE, min_ms DOUBLE, max_ms DOUBLE",
    ),
    TableFunction(
        "span_totals",
        "agent STRING",
        f"""SELECT agent_name, span_type, count(*), {_round("avg(duration_ms)", 0)}, {_round("max(duration_ms)", 0)}, {_round("sum(duration_ms)", 0)}
            FROM {{p}}_agent_events(agent) WHERE record_type = 'SPAN' AND span_type IN ({_TYPES}) GROUP BY agent_name, span_type""",
        "agent_name STRING, span_type STRING, span_count BIGINT, avg_duration_ms DOUBLE, max_duration_ms DOUBLE, total_duration_ms DOUBLE",
    ),
    TableFunction(
        "tool_breakdown",
        "agent STRING",
        f"""SELECT agent_name, tool, count(*), {_round("avg(took)", 0)}, {_round("max(took)", 0)}
            FROM (SELECT agent_name, CASE WHEN has_search THEN 'search' WHEN has_analyst THEN 'analyst' ELSE 'orchestration' END AS tool,
                         coalesce(search_ms, analyst_ms, orchestration_ms) AS took
                  FROM {{p}}_agent_events(agent) WHERE record_type = 'SPAN' AND (has_search OR has_analyst OR has_orchestration))
            GROUP BY agent_name, tool""",
        "agent_name STRING, tool_type STRING, invocations BIGINT, avg_duration_ms DOUBLE, max_duration_ms DOUBLE",
    ),
    TableFunction(
        "score_buckets",
        _BOTH,
        f"""SELECT agent_name, metric, CASE WHEN score = 1.0 THEN '{_B.perfect}' WHEN score >= 0.8 THEN '{_B.high}' WHEN score >= 0.6 THEN '{_B.middle}'
                   WHEN score >= 0.4 THEN '{_B.low}' ELSE '{_B.poor}' END AS bucket, count(*)
            FROM {{p}}_scores(agent, other_agent) GROUP BY ALL""",
        "agent_name STRING, metric STRING, score_bucket STRING, count BIGINT",
    ),
    TableFunction(
        "run_comparison",
        "agent STRING",
        f"""SELECT run_name, metric, count(*), {_round("avg(score)", 4)}, {_round("min(score)", 4)}, count_if(score = 1)
            FROM {{p}}_agent_events(agent) WHERE span_type = 'eval_root' AND has_score GROUP BY run_name, metric""",
        "run_name STRING, metric STRING, num_evals BIGINT, avg_score DOUBLE, min_score DOUBLE, perfect_count BIGINT",
    ),
    TableFunction(
        "metric_comparison",
        _BOTH + ", label STRING DEFAULT 'A', other_label STRING DEFAULT 'B'",
        f"""WITH judged AS (
              SELECT metric, avg(CASE WHEN is_a THEN score END) AS a, avg(CASE WHEN is_b THEN score END) AS b, count_if(is_a) AS a_n, count_if(is_b) AS b_n
              FROM (SELECT {_named("metric")} AS metric, score, agent_name = agent AS is_a, agent_name = other_agent AS is_b
                    FROM {{p}}_scores(agent, other_agent))
              GROUP BY metric)
            SELECT metric, {_round("a", 4)}, {_round("b", 4)}, {_round("a - b", 4)}, {_winner("a", "b", "label", "other_label")}, a_n, b_n FROM judged""",
        "normalized_metric STRING, a_avg DOUBLE, b_avg DOUBLE, delta DOUBLE, winner STRING, a_n BIGINT, b_n BIGINT",
    ),
    TableFunction(
        "query_delta",
        _BOTH + ", label STRING DEFAULT 'A', other_label STRING DEFAULT 'B'",
        f"""WITH {_SIDES}
            SELECT user_query, metric, {_round("a", 3)}, {_round("b", 3)}, {_round("a - b", 3)}, {_winner("a", "b", "label", "other_label")} FROM pairs""",
        "user_query STRING, metric STRING, a_score DOUBLE, b_score DOUBLE, delta DOUBLE, winner STRING",
    ),
    TableFunction(
        "win_loss_tie",
        _BOTH,
        f"""WITH {_SIDES},
            verdicts AS (SELECT metric, {_winner("a", "b", "'A'", "'B'")} AS verdict FROM pairs)
            SELECT metric, count_if(verdict = 'A'), count_if(verdict = 'B'), count_if(verdict = 'TIE'), count(*) FROM verdicts GROUP BY metric""",
        "metric STRING, a_wins BIGINT, b_wins BIGINT, ties BIGINT, total_queries BIGINT",
    ),
)


def _with_parts(only: tuple[str, ...]) -> set[str]:
    """The functions named and those they call."""
    calls = {f.name: {c for c in re.findall(r"\{p\}_(\w+)\(", f.body)} for f in (*SCANS, *REPORTS)}
    found, new = set(), set(only)
    while new:
        found |= new
        new = set().union(*[calls[f] for f in new]) - found
    return found


def register(spark: SparkSession, spans: DataFrame, name: str = "traces", only: tuple[str, ...] = ()) -> list[str]:
    """Register the functions over a span table (as ``read_spans`` gives it) in this session; returns their names.
    Registering a name again replaces its functions; results that were asked for before keep their source.
    With ``only`` these functions and those they call are registered, and the spans may lack columns that they do not use."""
    spans.createOrReplaceTempView(f"{name}_spans")
    chosen = _with_parts(only)
    every = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in spans.schema)
    made = []
    for f in (*SCANS, *REPORTS):
        if only and f.name not in chosen:
            continue
        body = f.body.replace("{p}", name)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{f.name}({f.arguments}) RETURNS TABLE ({f.returns or every}) RETURN {body}")
        made.append(f"{name}_{f.name}")
    return made
