"""Session settings and the shared scratch location."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", app: str = "tracegauge", scratch: str | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks; on a cluster use the session it gives you.
    ``scratch`` is its folder for intermediate tables; without one they go below the warehouse."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("TRACEGAUGE_SHUFFLE", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRACEGAUGE_DRIVER_MEMORY", "8g"))
    )
    spark = (builder.config("spark.checkpoint.dir", scratch) if scratch else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir`` of the session, or the warehouse
    where that is unset. Intermediate tables go below it on any master."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
