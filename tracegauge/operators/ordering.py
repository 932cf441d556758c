"""Positions inside ordered groups, safe for a group that holds a large part of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.operators.scratch import materialize

#: The most rows of one group that one task sorts.
MOST_SORTED = 1 << 17


def with_position(df: DataFrame, keys: Sequence[str], time: str, then_by: Sequence[str | Column], name: str = "position", zone: str = "SECOND") -> DataFrame:
    """Number the rows of each group from 1 in the order (time, then_by).

    A group is cut into time zones. Rows are numbered inside their zone and shifted by the row
    counts of the earlier zones, so a long trace is sorted by many tasks, not by one. ``zone`` is a
    ``date_trunc`` unit. If some zone has more than ``MOST_SORTED`` rows, say because a whole trace starts in
    one second or has no times, all rows are dealt to tasks by ranges of the full order instead. Rows with a
    NULL key belong to no group and are dropped; a NULL time sorts first. The counts of the zones are
    written once, so building the result runs jobs.
    """
    keys = list(keys)
    rows = df.dropna(subset=keys)
    zoned = rows.withColumn(
        "_zone", F.coalesce(F.unix_seconds(F.date_trunc(zone, F.col(time).cast("timestamp"))), F.lit(-(2**62)))
    )
    counts = materialize(_rows_in(zoned, keys, "_zone"), "zone-counts")
    size = counts.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    order = [F.col(time).asc_nulls_first(), *then_by]
    if (size["most"] or 0) <= MOST_SORTED:
        return _numbered(zoned, counts, keys, "_zone", order, name, size["all"] or 0)
    ranged = materialize(in_ranges(rows, [*keys, *order], size["all"]), "ranges")
    return _numbered(ranged, _rows_in(ranged, keys, "_range"), keys, "_range", order, name, size["all"])


def in_ranges(rows: DataFrame, order: Sequence[str | Column], n_rows: int) -> DataFrame:
    """The rows in ranges of an order, numbered upwards in ``_range``. Half of ``MOST_SORTED`` rows are meant
    for each, as Spark draws the bounds from a sample. Ties are cut by a hash of the other columns; only rows
    that are alike in all of them stay together. Write the result before it is read twice."""
    # Maps, also inside other types, and variants have no hash.
    plain = [f.name for f in rows.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    spread = F.xxhash64(*plain) if plain else F.lit(0)
    n_ranges = -(-2 * n_rows // MOST_SORTED)
    return rows.repartitionByRange(max(n_ranges, 1), *order, spread).withColumn("_range", F.spark_partition_id())


def _rows_in(rows: DataFrame, keys: list[str], part: str) -> DataFrame:
    return rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))


def dealt(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """The rows dealt by keys to as many tasks as keep each near half of ``MOST_SORTED`` rows, where the session has fewer
    partitions than that: their number is fixed, so the memory of a task would grow with the table."""
    tasks = -(-2 * n_rows // MOST_SORTED)
    few = tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows if few else rows.repartition(tasks, *keys)


def _numbered(rows: DataFrame, counts: DataFrame, keys: list[str], part: str, order: Sequence[str | Column], name: str, n_rows: int) -> DataFrame:
    """Rows numbered inside their part, shifted by the rows of the group's earlier parts."""
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    return (
        dealt(rows, n_rows, *keys, part)
        .join(shifts, [*keys, part])
        .withColumn(name, (F.col("_shift") + F.row_number().over(inside)).cast("bigint"))
        .drop(part, "_shift")
    )


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number all rows from 1 in an order. The rows are dealt to tasks by ranges of the order, numbered there
    and shifted by the rows of earlier ranges; only the counts of the ranges meet in one task. Rows are
    written twice, to count them and to fix their ranges, so building the result runs jobs."""
    rows = materialize(df, "rank-rows")
    n_rows = rows.count()
    ranged = materialize(in_ranges(rows, order, n_rows), "ranges")
    return _numbered(ranged, _rows_in(ranged, [], "_range"), [], "_range", order, name, n_rows)


def ranked_head(df: DataFrame, order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows in a total order, numbered from 1. The window runs over those k rows only."""
    head = df.orderBy(*order).limit(k)
    return head.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("bigint"))


def extreme_rows(df: DataFrame, keys: Sequence[str], time: str, tie: str, pick: Sequence[str], newest: bool = True, extra: Sequence[Column] = ()) -> DataFrame:
    """The newest (or oldest) row of each group with the columns ``pick``, ties decided by ``tie``,
    plus aggregates ``extra`` over the whole group. A NULL time counts as the newest.

    The time alone is reduced first, in hashed buffers; the wide columns are then read only for the
    few rows that carry the extreme time. Rows with a NULL key are dropped.
    """
    keys = list(keys)
    rows = df.dropna(subset=keys)
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(2**62))
    ends = rows.select("*", at.alias("_at")).groupBy(*keys).agg((F.max("_at") if newest else F.min("_at")).alias("_at"), *extra)
    carried = [c for c in ends.columns if c not in (*keys, "_at")]
    last = rows.select(*keys, at.alias("_at"), F.struct(*pick).alias("_row"), F.col(tie).alias("_tie")).join(ends, [*keys, "_at"])
    best = F.max_by("_row", "_tie") if newest else F.min_by("_row", "_tie")
    # The aggregates are the same on every row of a group.
    return (
        last.groupBy(*keys, *carried)
        .agg(best.alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}") for c in pick], *carried)
    )
