"""Latency of the agents over event-time windows, from event files as they arrive.

``windows`` is one definition for both worlds: over a stream it keeps a small state per open window and agent and
gives a window out once, when the watermark has passed its end; over a table it gives all windows. State and
progress live in the query's checkpoint, so a restarted query goes on where it was and repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegauge.operators.evaluations import roots
from tracegauge.operators.spans import extract_spans
from tracegauge.sources.attributes import EVENT_SCHEMA

WINDOW_SCHEMA = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("agent_name", T.StringType()),
        T.StructField("n_requests", T.LongType()),
        T.StructField("sum_ms", T.LongType()),
        T.StructField("max_ms", T.LongType()),
    ]
)


def event_stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """Event rows of the Parquet files below ``path``, old and new ones."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    return (reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)).parquet(path)


def windows(events: DataFrame, size: str, delay: str) -> DataFrame:
    """Requests, sum and maximum of their latency, per agent and tumbling window of ``size``. On a stream, an event that is more
    than ``delay`` older than the newest one may come too late for its window and is then left out."""
    requests = roots(extract_spans(events)).select("start_ts", "agent_name", "duration_ms").withWatermark("start_ts", delay)
    counted = requests.groupBy(F.window("start_ts", size).alias("w"), "agent_name").agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("duration_ms").alias("sum_ms"), F.max("duration_ms").alias("max_ms")
    )
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "agent_name", "n_requests", "sum_ms", "max_ms")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work off all files that are there now and append the finished windows to ``path``. Call it again for later files."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
