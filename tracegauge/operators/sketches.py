"""Approximate distinct counts and quantiles of any range of days, from sketches kept as data.

One pass over the requests writes a small row per agent and day: a HyperLogLog sketch and a KLL sketch of the
latencies, with their count. A range of days is answered by merging these rows; the spans are not read again.
New days are new rows, and rows of one day from several loads merge like any others.

Errors: a distinct count is off by more than ``distinct_error`` (three standard errors) for about one range
in 400. The rank of a quantile is off by ``RANK_ERROR`` at most with 99 percent confidence, whatever was merged.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logarithm of the number of HyperLogLog registers.
LG_REGISTERS = 12
#: Items that a KLL sketch keeps per level, and the rank error that follows from it.
KLL_ITEMS = 200
RANK_ERROR = 0.0165


def distinct_error(lg_registers: int = LG_REGISTERS) -> float:
    """Relative error of a merged distinct count: three standard errors."""
    return 3 * 1.04 / sqrt(1 << lg_registers)


def daily_sketches(requests: DataFrame, keys: tuple[str, ...] = ("agent_name",), value: str = "duration_ms", time: str = "start_ts", lg_registers: int = LG_REGISTERS) -> DataFrame:
    """One row per key and day: ``day``, ``n_rows``, ``n_values``, ``distincts`` and ``quantiles`` (sketches). NULL values are counted in
    ``n_rows`` only; rows without a time have a NULL day."""
    v = F.col(value).cast("bigint")
    return requests.groupBy(*keys, F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n_values"),
        F.hll_sketch_agg(v, lg_registers).alias("distincts"),
        F.kll_sketch_agg_bigint(v, KLL_ITEMS).alias("quantiles"),
    )


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Add sketch rows to a stored table, by day."""
    sketches.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(sketches: DataFrame, first: Column | None = None, last: Column | None = None, keys: tuple[str, ...] = ("agent_name",)) -> DataFrame:
    """One row per key for the days ``first`` to ``last`` (both included; None: open)."""
    if first is not None:
        sketches = sketches.filter(F.col("day") >= first)
    if last is not None:
        sketches = sketches.filter(F.col("day") <= last)
    return sketches.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_values").alias("n_values"),
        F.hll_union_agg("distincts").alias("distincts"),
        F.kll_merge_agg_bigint("quantiles").alias("quantiles"),
    )


def estimates(merged_sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``n_distinct`` and one column per name in ``shares``; NULL where there is no value."""
    some = F.col("n_values") > 0
    found = {name: F.when(some, F.kll_sketch_get_quantile_bigint("quantiles", F.lit(share))) for name, share in shares.items()}
    return merged_sketches.withColumns({"n_distinct": F.hll_sketch_estimate("distincts"), **found}).drop("distincts", "quantiles")


def rank_of(merged_sketches: DataFrame, value: Column) -> Column:
    """Approximate share of values up to ``value``."""
    return F.when(F.col("n_values") > 0, F.kll_sketch_get_rank_bigint("quantiles", value))
