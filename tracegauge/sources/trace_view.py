"""Agent-trace event table derived from the click-stream table ``events``.

Each event becomes one trace of nine rows: root, retrieval, graph node, generation, four
evaluations and a log line. The expressions below are plain SQL that Spark and other engines read
alike, so an independent engine can build the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TRACE = 9

CORE = [
    "event_id",
    "user_id",
    "n",
    "ts AS t0",
    "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k",
    "CAST(round(value * 100, 0) AS BIGINT) * 10 AS root_ms",
    "CASE WHEN event_id % 2 = 0 THEN 'AGENT_A' ELSE 'AGENT_B' END AS agent_name",
    "'rec-' || CAST(event_id AS STRING) AS record_id",
    """CASE WHEN user_id % 25 = 24 AND event_id % 2 = 0 THEN 'query-a-only'
            WHEN user_id % 25 = 23 AND event_id % 2 = 1 THEN 'query-b-only'
            ELSE 'query-' || CAST(user_id % 25 AS STRING) END AS user_query""",
]

FLAT = [
    """CASE n WHEN 0 THEN 'record_root' WHEN 1 THEN 'retrieval' WHEN 2 THEN 'graph_node'
              WHEN 3 THEN 'generation' WHEN 8 THEN NULL ELSE 'eval_root' END AS span_type""",
    """CASE n WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN 'answer_correctness' ELSE 'correctness' END
              WHEN 5 THEN 'groundedness' WHEN 6 THEN 'coherence' WHEN 7 THEN 'logical_consistency' END AS metric""",
    """CASE WHEN user_query IN ('query-0','query-1') THEN '1.0'
            WHEN (event_id + n) % 13 = 0 THEN 'null'
            ELSE '0.' || CASE WHEN (k * n + event_id) % 5 = 0 THEN '05' WHEN (k * n + event_id) % 5 = 1 THEN '45'
                 WHEN (k * n + event_id) % 5 = 2 THEN '65' WHEN (k * n + event_id) % 5 = 3 THEN '85'
                 ELSE '999' END END AS score_json""",
    "CASE WHEN n = 0 THEN root_ms ELSE CAST(floor(root_ms * n / 8) AS BIGINT) END AS dur_ms",
    """'{' || chr(39) || 'input_tokens' || chr(39) || ': ' || CAST(90 + k AS STRING) || ', ' || chr(39) || 'output_tokens' || chr(39) || ': ' || CAST(15 + user_id % 5 AS STRING) || ', ' || chr(39) || 'total_tokens' || chr(39) || ': ' || CAST(105 + k + user_id % 5 AS STRING) || ', ' || chr(39) || 'ok' || chr(39) || ': ' || CASE WHEN event_id % 3 = 0 THEN 'False' ELSE 'True' END || '}' AS usage_text""",
    # Further calls of the same node: one more that can be read and one with a missing count, or one with details of its own.
    """CASE user_id % 3
            WHEN 1 THEN ' AIMessage(usage_metadata={' || chr(39) || 'input_tokens' || chr(39) || ': ' || CAST(11 + k AS STRING) || ', ' || chr(39) || 'total_tokens' || chr(39) || ': 40}) AIMessage(usage_metadata={' || chr(39) || 'input_tokens' || chr(39) || ': None})'
            WHEN 2 THEN ' AIMessage(usage_metadata={' || chr(39) || 'input_tokens' || chr(39) || ': 7, ' || chr(39) || 'details' || chr(39) || ': {' || chr(39) || 'cached' || chr(39) || ': 5}})'
            ELSE '' END AS more_calls""",
]


def _when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} ELSE '' END"


#: The attributes that all nine rows of a trace share.
SHARED = " || ".join(
    [
        """'{"obs.agent.name":"' || agent_name || '","obs.record_id":"' || record_id || '"'""",
    """',"obs.agent.type":"' || CASE agent_name WHEN 'AGENT_A' THEN 'NATIVE AGENT' ELSE 'EXTERNAL AGENT' END || '"'""",
        # The run name is stored under an older attribute name in a third of the traces.
        """CASE WHEN event_id % 3 = 2 THEN ',"obs.legacy.run.name":"RUN_' ELSE ',"obs.run.name":"RUN_' END || CAST(event_id % 3 AS STRING) || '"'""",
    ]
)

OWN = " || ".join(
    [
        _when("span_type IS NOT NULL", """',"obs.span_type":"' || span_type || '"'"""),
        _when(
            "n = 0",
            """',"obs.root.input":"' || user_query || '","obs.root.output":"answer ' || CAST(k AS STRING) || ' for ' || user_query || '"'""",
        ),
        _when("n = 0 AND agent_name = 'AGENT_A'", """',"obs.agent.duration":' || CAST(root_ms AS STRING)"""),
        _when(
            "n = 0 AND agent_name = 'AGENT_B' AND event_id % 5 <> 0",
            """',"obs.call.return":"AIMessage(usage_metadata=' || usage_text || ')"'""",
        ),
        _when(
            "n = 1 AND agent_name = 'AGENT_A'",
            """',"obs.tool.search.name":"case_search","obs.tool.search.duration":' || CAST(dur_ms AS STRING) || ',"obs.tool.search.query":"cases about ' || user_query || '","obs.tool.search.status":"' || CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END || '"'""",
        ),
        _when("n = 1 AND agent_name = 'AGENT_B'", """',"obs.retrieval.query_text":"find ' || user_query || '"'"""),
        _when(
            "n = 2 AND agent_name = 'AGENT_A'",
            """',"obs.tool.analyst.model":"support","obs.tool.analyst.duration":' || CAST(dur_ms AS STRING) || ',"obs.tool.analyst.sql_query":"SELECT avg(csat_score), count(*), min(case_date), max(case_date) FROM case_metrics WHERE priority IN (1, 2, 3) AND interactions >= ' || CAST(k AS STRING) || ' GROUP BY product"'""",
        ),
        _when(
            "n = 3 AND agent_name = 'AGENT_A'",
            """',"obs.tokens.input":' || CAST(100 + k AS STRING) || ',"obs.tokens.output":' || CAST(20 + user_id % 7 AS STRING) || ',"obs.tokens.total":' || CAST(120 + k + user_id % 7 AS STRING) || ',"obs.planning.response":"plan ' || CAST(k AS STRING) || '"'""",
        ),
        _when(
            "n = 2 AND agent_name = 'AGENT_B'",
            """',"obs.call.function":"agent_node","obs.call.return":"AIMessage(usage_metadata=' || usage_text || ')' || more_calls || '"'""",
        ),
        _when("n = 3 AND agent_name = 'AGENT_B'", """',"obs.call.function":"chat_model"'"""),
        _when(
            "n BETWEEN 4 AND 7",
            """',"obs.eval.metric_name":"' || metric || '","obs.eval.target_record_id":"' || record_id || '","obs.eval.score":' || score_json""",
        ),
        "'}'",
    ]
)

ATTRIBUTES = f"{SHARED} || {OWN}"

ROW = [
    "CASE WHEN n = 8 THEN 'LOG' ELSE 'SPAN' END AS record_type",
    """'{"trace_id":"tr-' || CAST(event_id AS STRING) || '"}' AS trace""",
    """CASE WHEN n = 8 THEN '{"severity_text":"' || CASE WHEN event_id % 4 = 0 THEN 'ERROR' WHEN event_id % 4 = 1 THEN 'WARN' ELSE 'INFO' END || '"}' END AS record""",
    f"{ATTRIBUTES} AS record_attributes",
    "t0",
    "n",
    "dur_ms",
]


def trace_events(events: DataFrame) -> DataFrame:
    """The event table: record_type, start_timestamp, timestamp, trace, record, record_attributes.

    The narrow rows are dealt out before each becomes nine wide ones, as a file of the test table
    cannot be split."""
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        events.repartition(parts, "event_id")
        .selectExpr(*[c for c in CORE if c != "n"])
        .selectExpr("*", f"{SHARED} AS shared")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(ROWS_PER_TRACE - 1))).alias("n"))
        .selectExpr("*", *FLAT)
        .selectExpr(*[c.replace(ATTRIBUTES, f"shared || {OWN}") for c in ROW])
    )
    start = F.timestamp_add("MILLISECOND", F.col("n"), F.col("t0").cast("timestamp"))
    return rows.select(
        "record_type",
        start.alias("start_timestamp"),
        F.timestamp_add("MILLISECOND", F.col("dur_ms"), start).alias("timestamp"),
        "trace",
        "record",
        "record_attributes",
    )
