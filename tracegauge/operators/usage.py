"""Token usage per record: from attributes, or recovered from serialized call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USAGE_MARK = "usage_metadata"
# Patterns of the serialized call log.
USAGE_PATTERN = r"usage_metadata=(\{[^}]+\})"
INPUT_TOKENS_PATTERN = r"input_tokens.: (\d+)"


def logged_input_tokens(call_return: Column) -> Column:
    """First input-token count in a call log, NULL if there is none."""
    return F.nullif(F.regexp_extract(call_return, INPUT_TOKENS_PATTERN, 1), F.lit("")).cast("bigint")


def usage_variant(text: Column, lenient: bool = False) -> Column:
    """Parse a usage literal written in Python notation.

    Only quotes and ``True`` are rewritten, so text with ``False``, ``None`` or a nested brace does
    not parse and gives NULL. ``lenient`` also rewrites ``False`` and ``None``.
    """
    json = F.replace(F.translate(text, "'", '"'), F.lit("True"), F.lit("true"))
    if lenient:
        json = F.replace(F.replace(json, F.lit("False"), F.lit("false")), F.lit("None"), F.lit("null"))
    return F.try_parse_json(json)


def logged_usage(spans: DataFrame, agent: str, lenient: bool = False) -> DataFrame:
    """One row per parsed usage literal in the graph-node call logs of an agent."""
    calls = spans.filter(
        (F.col("agent_name") == agent)
        & (F.col("span_type") == "graph_node")
        & F.col("call_return").contains(USAGE_MARK)
    )
    found = calls.select("record_id", F.explode_outer(F.regexp_extract_all("call_return", F.lit(USAGE_PATTERN), F.lit(1))).alias("_text"))
    usage = found.select("record_id", usage_variant(F.col("_text"), lenient).alias("_usage")).filter(F.col("_usage").isNotNull())

    def count_of(key: str) -> Column:
        return F.try_variant_get("_usage", f"$.{key}", "decimal(38,0)").cast("bigint")

    return usage.select(
        "record_id",
        count_of("input_tokens").alias("tokens_in"),
        count_of("output_tokens").alias("tokens_out"),
        count_of("total_tokens").alias("tokens_total"),
    )


def token_totals(usage: DataFrame) -> DataFrame:
    """Sums per record. Partial sums are built before the shuffle, so one busy record costs no more
    than any other."""
    return usage.groupBy("record_id").agg(
        F.sum("tokens_in").alias("prompt_tokens"),
        F.sum("tokens_out").alias("completion_tokens"),
        F.sum("tokens_total").alias("total_tokens"),
    )


def attribute_usage(spans: DataFrame, agent: str) -> DataFrame:
    """Rows of an agent that carry token attributes. Rows without any add nothing to a sum, and a
    record without any ends as NULL either way."""
    return spans.filter((F.col("agent_name") == agent) & F.coalesce("tokens_in", "tokens_out", "tokens_total").isNotNull()).select(
        "record_id", "tokens_in", "tokens_out", "tokens_total"
    )
