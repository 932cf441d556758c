"""Scratch tables and text keys shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table: below ``spark.checkpoint.dir``, or below the warehouse
    where that is unset. Both are storage that all executors share. Scratch tables belong to the
    application that wrote them; ``drop_scratch`` removes them."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def _base(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-scratch/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this application. Call it when no DataFrame reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and read it back. It is computed once, its lineage
    ends there, and it survives any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text (null counts as empty). Equal texts share their key, so
    work on repeated rows and copies is done once, whatever ids the rows carry."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(2654435769), t).alias("k2")]


def checkpointed(df: DataFrame) -> DataFrame:
    """Fix a result with its partitions and their order in the shared folder, for passes that rely on both."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{_base(df.sparkSession)}/checkpoints")
    return df.checkpoint()
