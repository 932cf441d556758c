"""Names of the attributes inside an event row and the typed columns they become.

Attribute names are flat and contain dots. Deployments differ in the names they use, so every name
is a field that can be replaced: ``dataclasses.replace(AttributeKeys(), agent_name="my.agent")``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T


@dataclass(frozen=True)
class AttributeKeys:
    """Typed column -> attribute name. Several names separated by ``|`` are tried in turn."""

    agent_name: str = "obs.agent.name"
    agent_type: str = "obs.agent.type"
    span_type: str = "obs.span_type"
    record_id: str = "obs.record_id"
    user_query: str = "obs.root.input"
    agent_output: str = "obs.root.output"
    metric: str = "obs.eval.metric_name"
    score: str = "obs.eval.score"
    target_record_id: str = "obs.eval.target_record_id"
    run_name: str = "obs.run.name|obs.legacy.run.name"
    call_return: str = "obs.call.return"
    call_function: str = "obs.call.function"
    retrieval_query: str = "obs.retrieval.query_text"
    orchestration_ms: str = "obs.agent.duration"
    search_name: str = "obs.tool.search.name"
    search_ms: str = "obs.tool.search.duration"
    search_query: str = "obs.tool.search.query"
    search_status: str = "obs.tool.search.status"
    analyst_model: str = "obs.tool.analyst.model"
    analyst_ms: str = "obs.tool.analyst.duration"
    analyst_sql: str = "obs.tool.analyst.sql_query"
    tokens_in: str = "obs.tokens.input"
    tokens_out: str = "obs.tokens.output"
    tokens_total: str = "obs.tokens.total"
    planning_output: str = "obs.planning.response"

    def names(self, column: str) -> list[str]:
        return getattr(self, column).split("|")

    @classmethod
    def columns(cls) -> list[str]:
        return [f.name for f in fields(cls)]


# Attributes that are not text.
DOUBLE_COLUMNS = {"score"}
WHOLE_COLUMNS = {"orchestration_ms", "search_ms", "analyst_ms", "tokens_in", "tokens_out", "tokens_total"}

# Presence of the attribute itself: a JSON null counts as present, a missing key does not.
PRESENCE = {
    "has_score": "score",
    "has_search": "search_name",
    "has_analyst": "analyst_model",
    "has_orchestration": "orchestration_ms",
}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("start_timestamp", T.TimestampType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("trace", T.StringType()),
        T.StructField("record", T.StringType()),
        T.StructField("record_attributes", T.StringType()),
    ]
)

#: Columns of the event table that hold objects.
OBJECT_COLUMNS = ("trace", "record", "record_attributes")

SPAN_SCHEMA = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("start_ts", T.TimestampType()),
        T.StructField("end_ts", T.TimestampType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]
    + [
        T.StructField(
            c,
            T.DoubleType() if c in DOUBLE_COLUMNS else T.LongType() if c in WHOLE_COLUMNS else T.StringType(),
        )
        for c in AttributeKeys.columns()
    ]
    + [T.StructField(c, T.BooleanType()) for c in PRESENCE]
)
