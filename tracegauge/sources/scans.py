"""Scans with literal arguments: events of an agent, evaluation data of a run, logs, job history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegauge.operators.ordering import ranked_head
from tracegauge.sources.attributes import EVENT_SCHEMA, OBJECT_COLUMNS


def event_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored event table (Parquet), ready for ``extract_spans``. Its attribute columns are JSON text or native objects."""
    rows = spark.read.parquet(path)
    missing = [f.name for f in EVENT_SCHEMA if f.name not in rows.columns]
    if missing:
        raise ValueError(f"no event table, it lacks {', '.join(missing)}")
    return rows.select(*EVENT_SCHEMA.names)


def write_event_table(events: DataFrame, path: str, mode: str = "append") -> None:
    """Store event rows with native objects. Spark shreds them into a column per attribute that is frequent in a file, so a
    query reads the attributes it uses and no others. Text that is no JSON becomes NULL."""
    columns = [F.try_parse_json(f.name).alias(f.name) if f.name in OBJECT_COLUMNS and isinstance(f.dataType, T.StringType) else F.col(f.name) for f in events.schema]
    events.select(*columns).write.mode(mode).parquet(path)


def agent_events(spans: DataFrame, agent: str, agent_type: str | None = None) -> DataFrame:
    """All rows of one agent, or of the one with this type where several share a name. On the stored span
    table this reads that agent's folders only."""
    rows = spans.filter(F.col("agent_name") == agent)
    return rows if agent_type is None else rows.filter(F.col("agent_type") == agent_type)


def all_events(*scans: DataFrame) -> DataFrame:
    """Several scans as one. For agents of one table prefer a single scan with an IN list."""
    return reduce(lambda a, b: a.unionByName(b), scans)


def run_events(spans: DataFrame, run: str) -> DataFrame:
    return spans.filter(F.col("run_name") == run)


def newest_first(time: str = "end_ts") -> list[Column]:
    """A total order over evaluation rows: latest first, ties by record, metric and start."""
    return [F.col(time).desc_nulls_first(), F.col("record_id").asc(), F.col("metric").asc(), F.col("start_ts").asc()]


def eval_run_latest(spans: DataFrame, agent: str, run: str, newest: int = 50) -> DataFrame:
    """The newest evaluation rows of one run. The limit is part of the report."""
    rows = spans.filter((F.col("agent_name") == agent) & (F.col("run_name") == run) & (F.col("span_type") == "eval_root"))
    return ranked_head(rows, newest_first(), newest)


def logs_by_severity(spans: DataFrame, agent: str, run: str, severities: Sequence[str] | None = ("ERROR", "WARN")) -> DataFrame:
    """Log rows of one agent and run; ``None`` keeps every severity."""
    rows = spans.filter((F.col("record_type") == "LOG") & (F.col("agent_name") == agent) & (F.col("run_name") == run))
    return rows if severities is None else rows.filter(F.col("severity").isin(*severities))


def record_lookup(spans: DataFrame, record_id: str) -> DataFrame:
    """Rows of one record: the planning output first, then every column."""
    return spans.filter(F.col("record_id") == record_id).select(F.col("planning_output").alias("planning"), "*")


def job_history(
    jobs: DataFrame,
    patterns: Sequence[str],
    days: int = 7,
    cap: int = 50,
    errors_only: bool = False,
    until: Column | None = None,
) -> DataFrame:
    """Recent jobs (name, state, job_id, scheduled_time, ...), newest first.

    The cap is an argument of the scan: the newest ``cap`` rows of the time range are taken first
    and the name patterns are applied to those. ``until`` stands for the current time.
    """
    now = F.current_timestamp() if until is None else until
    rows = jobs.filter(F.col("scheduled_time") >= now - F.make_dt_interval(F.lit(days)))
    if errors_only:
        rows = rows.filter(F.col("state") == "FAILED")
    newest = rows.orderBy(F.col("scheduled_time").desc(), F.col("job_id").asc()).limit(cap)
    named = reduce(lambda a, b: a | b, [F.col("name").ilike(p) for p in patterns])
    return newest.filter(named).orderBy(F.col("scheduled_time").desc(), F.col("job_id").asc())


def first_rows(df: DataFrame, order: Sequence[Column], rows: int) -> DataFrame:
    """Head of a result for display, in a stated order."""
    return ranked_head(df, order, rows)
