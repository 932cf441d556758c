"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegauge.session import shared_dir


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables. The application owns them: nothing else
    reads them, and ``drop_scratch`` removes them."""
    return f"{shared_dir(spark)}/tracegauge/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the application's intermediate tables, once no DataFrame reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and read it back: it is computed once, its
    lineage ends there, and it outlives any executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_side(df: DataFrame, limit: int = 64 * 1024 * 1024) -> DataFrame:
    """Mark the smaller side of a join by its measured size: broadcast up to ``limit`` bytes, else a
    sort-merge join. Spark's own estimate is no guide where a side was exploded from texts.
    Measuring reads the DataFrame once more."""
    width = F.lit(0)
    for f in df.schema:
        text = isinstance(f.dataType, (T.StringType, T.BinaryType))
        width = width + (F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if text else F.lit(16))
    size = df.agg(F.sum(width.cast("bigint")).alias("size")).first()["size"] or 0
    return F.broadcast(df) if size <= limit else df.hint("merge")
