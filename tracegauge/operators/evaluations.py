"""Evaluation scores attached to the question they judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_agents(spans: DataFrame, agents: tuple[str, ...] | None) -> DataFrame:
    return spans if agents is None else spans.filter(F.col("agent_name").isin(*agents))


def roots(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("span_type") == "record_root")


def scored(spans: DataFrame) -> DataFrame:
    """Evaluation rows whose score attribute is present; the score itself may still be NULL."""
    return spans.filter((F.col("span_type") == "eval_root") & F.col("has_score"))


def scores_by_question(spans: DataFrame, metric: Column, score: Column | None = None) -> DataFrame:
    """(agent_name, user_query, metric) -> average score over all records and runs, as ``avg_score``.

    Equals the average over the join of roots and evaluations on (agent, record). Both sides are
    reduced per record before they meet, so a record with very many evaluations, or one repeated
    root, is a single row in the join. Rows whose scores are all NULL stay, with a NULL average.
    """
    value = F.col("score") if score is None else score
    evals = (
        scored(spans)
        .select("agent_name", F.col("target_record_id").alias("record_id"), metric.alias("metric"), value.alias("_v"))
        .groupBy("agent_name", "record_id", "metric")
        .agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    )
    asked = roots(spans).groupBy("agent_name", "record_id", "user_query").agg(F.count(F.lit(1)).alias("_m"))
    return (
        asked.join(evals, ["agent_name", "record_id"])
        .groupBy("agent_name", "user_query", "metric")
        .agg(
            (
                F.sum(F.col("_s").cast("double") * F.col("_m")) / F.nullif(F.sum(F.col("_n") * F.col("_m")), F.lit(0)).cast("double")
            ).alias("avg_score")
        )
    )
