"""Metric layer over the support tables."""

from __future__ import annotations

from tracegauge.plans.metrics import Field, LogicalTable, Metric, MetricLayer

# Names, synonyms, enumerations and metric definitions that users ask by.
CASE_METRICS = LogicalTable(
    name="case_metrics",
    primary_key=("case_id",),
    dimensions=(
        Field("case_id"),
        Field("customer_id", synonyms=("customer", "account")),
        Field(
            "product",
            synonyms=("product name", "application"),
            values=("CloudStore Platform", "DataSync Pro", "SecureVault", "AnalyticsHub", "API Gateway"),
        ),
        Field(
            "issue_category",
            synonyms=("category", "issue type", "problem type"),
            values=(
                "Login/Authentication",
                "Performance",
                "Billing",
                "Data Loss",
                "Integration",
                "Feature Request",
                "Configuration",
                "Security",
            ),
        ),
        Field("priority", synonyms=("severity", "urgency"), values=("Low", "Medium", "High", "Critical")),
    ),
    time_dimensions=(Field("case_date", synonyms=("date", "opened date", "created date")),),
    facts=(
        Field("first_response_time_mins", synonyms=("first response time", "initial response time", "FRT")),
        Field("resolution_time_hours", synonyms=("resolution time", "time to resolve", "TTR")),
        Field("num_interactions", synonyms=("interactions", "touchpoints", "number of contacts")),
        Field("csat_score", synonyms=("satisfaction score", "customer satisfaction", "CSAT")),
        Field("escalated_flag", expr="escalated", synonyms=("escalated", "was escalated")),
    ),
    metrics=(
        Metric("total_cases", "count(case_id)", ("case count", "number of cases", "case volume")),
        Metric("avg_first_response_time", "avg(first_response_time_mins)", ("average first response", "mean FRT")),
        Metric("avg_resolution_time", "avg(resolution_time_hours)", ("average resolution time", "mean resolution time", "mean TTR")),
        Metric("avg_csat", "avg(csat_score)", ("average satisfaction", "average CSAT score", "mean CSAT")),
        Metric("escalation_rate", "avg(escalated_flag)", ("escalation percentage", "pct escalated")),
        Metric("avg_interactions", "avg(num_interactions)", ("average interactions", "mean touchpoints")),
    ),
)

DAILY_SUPPORT_METRICS = LogicalTable(
    name="daily_support_metrics",
    primary_key=("metric_date",),
    time_dimensions=(Field("metric_date", synonyms=("date", "day", "report date")),),
    facts=(
        Field("total_cases", synonyms=("daily cases", "case volume")),
        Field("cases_resolved", synonyms=("resolved cases", "cases closed")),
        Field("cases_escalated", synonyms=("escalated cases",)),
        Field("avg_resolution_time_hours"),
        Field("avg_csat_score"),
        Field("avg_first_response_mins"),
    ),
    metrics=(
        Metric("sum_daily_cases", "sum(total_cases)", ("total daily cases",)),
        Metric("sum_daily_resolved", "sum(cases_resolved)", ("total resolved",)),
        Metric("daily_avg_csat", "avg(avg_csat_score)", ("average daily CSAT",)),
        Metric("daily_avg_resolution_time", "avg(avg_resolution_time_hours)"),
    ),
)

REP_PERFORMANCE = LogicalTable(
    name="rep_performance",
    dimensions=(Field("rep_name", synonyms=("rep", "support rep", "agent", "representative")),),
    time_dimensions=(Field("week_start", synonyms=("week", "week beginning", "week of")),),
    facts=(
        Field("cases_handled", synonyms=("cases worked", "tickets handled")),
        Field("cases_resolved", synonyms=("cases closed", "tickets resolved")),
        Field("avg_resolution_time_hours"),
        Field("avg_csat_score"),
        Field("escalation_rate"),
    ),
    metrics=(
        Metric("total_rep_cases", "sum(cases_handled)", ("total handled",)),
        Metric("total_rep_resolved", "sum(cases_resolved)"),
        Metric("rep_avg_csat", "avg(avg_csat_score)", ("rep satisfaction",)),
        Metric("rep_avg_resolution_time", "avg(avg_resolution_time_hours)"),
        Metric("rep_avg_escalation_rate", "avg(escalation_rate)", ("rep escalation rate",)),
        # Resolved over handled, both summed first.
        Metric("rep_resolution_rate", "try_divide(sum(cases_resolved), sum(cases_handled))", ("resolution rate",)),
    ),
)

VERIFIED = {
    "total_cases_by_product": {"metrics": ["total_cases"], "dimensions": ["product"], "order_by": [("total_cases", "desc"), ("product", "asc")]},
    "avg_csat_by_category": {"metrics": ["avg_csat"], "dimensions": ["issue_category"], "order_by": [("avg_csat", "desc"), ("issue_category", "asc")]},
    "top_reps_by_volume": {"metrics": ["total_rep_cases"], "dimensions": ["rep_name"], "order_by": [("total_rep_cases", "desc"), ("rep_name", "asc")]},
    "escalation_rate_by_priority": {"metrics": ["escalation_rate"], "dimensions": ["priority"], "order_by": [("escalation_rate", "desc"), ("priority", "asc")]},
    "daily_trend": {"dimensions": ["metric_date"], "facts": ["total_cases", "avg_csat_score"], "order_by": [("metric_date", "asc")]},
}

SUPPORT_LAYER = MetricLayer(tables=(CASE_METRICS, DAILY_SUPPORT_METRICS, REP_PERFORMANCE), verified=VERIFIED)
