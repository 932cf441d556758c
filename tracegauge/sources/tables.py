"""Typed tables: schemas, positional CSV load, table and dataset sinks, evaluation input frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


TEXT, DATE, INT, DOUBLE, VARIANT = T.StringType(), T.DateType(), T.IntegerType(), T.DoubleType(), T.VariantType()

# Column names, order and types of the input files.
SUPPORT_CASES = T.StructType(
    [
        T.StructField("case_id", TEXT),
        T.StructField("customer_id", TEXT),
        T.StructField("case_date", DATE),
        T.StructField("product", TEXT),
        T.StructField("issue_category", TEXT),
        T.StructField("issue_summary", TEXT),
        T.StructField("resolution_summary", TEXT),
        T.StructField("rep_name", TEXT),
        T.StructField("status", TEXT),
        T.StructField("priority", TEXT),
    ]
)
CASE_METRICS = T.StructType(
    [
        T.StructField("case_id", TEXT),
        T.StructField("customer_id", TEXT),
        T.StructField("case_date", DATE),
        T.StructField("product", TEXT),
        T.StructField("issue_category", TEXT),
        T.StructField("priority", TEXT),
        T.StructField("first_response_time_mins", INT),
        T.StructField("resolution_time_hours", DOUBLE),
        T.StructField("num_interactions", INT),
        T.StructField("csat_score", DOUBLE),
        T.StructField("escalated", INT),
    ]
)
DAILY_SUPPORT_METRICS = T.StructType(
    [
        T.StructField("metric_date", DATE),
        T.StructField("total_cases", INT),
        T.StructField("cases_resolved", INT),
        T.StructField("cases_escalated", INT),
        T.StructField("avg_resolution_time_hours", DOUBLE),
        T.StructField("avg_csat_score", DOUBLE),
        T.StructField("avg_first_response_mins", DOUBLE),
    ]
)
REP_PERFORMANCE = T.StructType(
    [
        T.StructField("rep_name", TEXT),
        T.StructField("week_start", DATE),
        T.StructField("cases_handled", INT),
        T.StructField("cases_resolved", INT),
        T.StructField("avg_resolution_time_hours", DOUBLE),
        T.StructField("avg_csat_score", DOUBLE),
        T.StructField("escalation_rate", DOUBLE),
    ]
)
EVAL_DATA = T.StructType(
    [
        T.StructField("input_query", TEXT),
        T.StructField("ground_truth_data", VARIANT),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Load a CSV file by column position: one header line, optional quotes, doubled quotes as
    escape, line breaks inside quotes, compression by file extension. A value that does not fit its
    type raises, as a typed load does; a variant column is parsed from JSON text."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True)
    return raw.select(
        *[
            (F.parse_json(F.col(f.name)) if isinstance(f.dataType, T.VariantType) else F.col(f.name).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def replace_table(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Create or replace a typed table."""
    (df if schema is None else df.select(*[F.col(f.name).cast(f.dataType) for f in schema])).write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Insert rows; columns are matched by the names of the schema."""
    (df if schema is None else df.select(*[F.col(f.name).cast(f.dataType) for f in schema])).write.mode("append").parquet(path)


def search_corpus(cases: DataFrame, text: str, resolution: str, name: str = "corpus_text") -> DataFrame:
    """Every column, plus the searchable text: issue, then resolution. A missing resolution counts
    as empty, so the case stays searchable."""
    joined = F.concat(F.col(text), F.lit(" Resolution: "), F.coalesce(F.col(resolution), F.lit("")))
    return cases.withColumn(name, joined)


def eval_dataset(source: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Evaluation dataset: role -> source column."""
    return source.select(*[F.col(column).alias(role) for role, column in roles.items()])


def write_dataset_version(dataset: DataFrame, path: str, version: str) -> None:
    """One folder per version; a version is written once."""
    dataset.write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_dataset_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def user_message(question: Column) -> Column:
    """A question as the message object an agent takes."""
    return F.struct(F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))).alias("messages"))


def eval_inputs(dataset: DataFrame, question: str = "input_query", truth: str = "ground_truth_data") -> DataFrame:
    """Input frame of an evaluation run: the wrapped question and the ground truth text."""
    parsed = F.col(truth) if isinstance(dataset.schema[truth].dataType, T.VariantType) else F.parse_json(F.col(truth))
    return dataset.select(
        question,
        user_message(F.col(question)).alias("query_json"),
        F.try_variant_get(parsed, "$.ground_truth_output", "string").alias("ground_truth_string"),
    )


def apply_dataset_spec(frame: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Rename columns by a specification: role -> column."""
    return frame.select(*[F.col(column).alias(role) for role, column in spec.items()])
