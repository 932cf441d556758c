"""Exact group statistics, percentiles included, without holding a group in one task.

The usual exact percentile keeps every distinct value of a group in one hash table. Here rows are first
reduced to (group, value, count) with map-side combining and the values are cut into zones of about equal
relative width, so one rule fits scores, milliseconds and anything else. The running count over zones tells
which zones hold the wanted ranks. Those alone are opened. While one of them has more than ``MOST_SORTED``
different values they are cut again, into parts of equal width between their least and largest value; only
what is left is sorted by value.

A zone covers at most 2^44 different doubles, so two cuts into 2^15 parts always do. Whole numbers beyond
2^53 that are one double stay together. The counts of different values are written once; building the
result runs these jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.operators.scratch import materialize

ZONES_PER_BINADE = 256
PARTS = 1 << 15
#: The most different values of one group that one task sorts.
MOST_SORTED = 1 << 14


def zone_of(value: Column) -> Column:
    """Number of the zone of a value; never falls as the value grows. NULL has none, NaN the last."""
    v = value.cast("double")
    size = F.abs(v)
    exponent = F.floor(F.log2(F.when(size < float("inf"), size))).cast("double")
    # Runs on through powers of two, so a logarithm that is off by a last digit next to one does no harm.
    above_least = (exponent + 1100) * ZONES_PER_BINADE + (size / F.pow(F.lit(2.0), exponent) - 1) * ZONES_PER_BINADE
    signed = F.signum(v) * F.coalesce(above_least, F.when(size > 0, F.lit(2.0**30)), F.lit(0.0))
    return F.when(F.isnan(v), F.lit(2**31)).otherwise(F.floor(signed))


def edge_of(zone: Column) -> Column:
    """A value at the edge of a zone."""
    size = F.abs(zone).cast("double")
    exponent = F.floor(size / ZONES_PER_BINADE).cast("double")
    edge = F.pow(F.lit(2.0), exponent - 1100) * (1 + size / ZONES_PER_BINADE - exponent)
    return F.when(zone == 0, F.lit(0.0)).otherwise(F.signum(zone.cast("double")) * edge)


def part_of(value: Column, least: Column, largest: Column) -> Column:
    """Number of the part of a value between two bounds, from 0 to PARTS."""
    # Halves, as the difference of two doubles may be too large for one.
    width = largest.cast("double") / 2 - least.cast("double") / 2
    share = (value.cast("double") / 2 - least.cast("double") / 2) / F.nullif(width, F.lit(0.0))
    return F.coalesce(F.floor(F.when(~F.isnan(share), share) * PARTS), F.lit(0))


def value_profile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: Mapping[str, float],
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group: n_rows, n_values, n_distinct, v_sum, v_m2 (squared distances from the mean, added
    up), v_min, v_max, one column per percentile (linear interpolation) and one per entry of ``sums``, a
    column expression over the value that is summed over the rows.

    Rows with a NULL value count in n_rows only. Infinite values are ordinary ones at the ends; NaN is the
    largest.
    """
    keys = list(keys)
    sums = dict(sums or {})
    v, n = F.col(value), F.col("_n")
    counted = materialize(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_zone", zone_of(v)), "value-counts")
    off = v.cast("double") - edge_of(F.col("_zone"))
    zones = counted.groupBy(*keys, "_zone").agg(
        F.sum("_n").alias("_zn"),
        F.count(v).alias("_zd"),
        F.sum(v.cast("double") * n).alias("_zs"),
        F.sum(off * n).alias("_off"),
        F.sum(off * off * n).alias("_off2"),
        F.min(v).alias("_least"),
        F.max(v).alias("_largest"),
        *[F.sum(expr.cast("double") * n).alias(f"_s_{name}") for name, expr in sums.items()],
    )
    group = Window.partitionBy(*keys)
    known = F.when(F.col("_zone").isNotNull(), F.col("_zn"))
    stats = ["n_rows", "n_values", "n_distinct", "v_sum", "v_m2", "v_min", "v_max", *sums]
    totals = zones.select(
        *keys,
        "_zone",
        "_zn",
        F.col("_zd").alias("_in"),
        "_least",
        "_largest",
        "_zs",
        F.greatest(F.col("_off2") - F.col("_off") * F.col("_off") / F.col("_zn"), F.lit(0.0)).alias("_zm2"),
        _count_before(known, group, "_zone").alias("_before"),
        F.sum("_zn").over(group).alias("n_rows"),
        F.coalesce(F.sum(known).over(group), F.lit(0)).alias("n_values"),
        F.sum("_zd").over(group).alias("n_distinct"),
        F.sum("_zs").over(group).alias("v_sum"),
        F.min("_least").over(group).alias("v_min"),
        F.max("_largest").over(group).alias("v_max"),
        *[F.sum(f"_s_{name}").over(group).alias(name) for name in sums],
    )
    # Squared distances inside each zone, and of the means of the zones. What cancels is of the width of a zone.
    apart = F.col("_zs") / F.col("_zn") - F.col("v_sum") / F.nullif(F.col("n_values"), F.lit(0))
    totals = totals.withColumn("v_m2", F.sum(F.col("_zm2") + F.col("_zn") * apart * apart).over(group)).drop("_zs", "_zm2")

    def ranks(p: float) -> tuple[Column, Column, Column]:
        position = F.lit(float(p)) * (F.col("n_values") - 1)
        return F.floor(position), F.ceil(position), position - F.floor(position)

    def holds_wanted(count: str) -> Column:
        wanted = F.lit(False)
        for p in percentiles.values():
            for rank in ranks(p)[:2]:
                wanted = wanted | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col(count)))
        return wanted

    without_values = F.col("n_values") == 0
    opened = totals.filter(without_values | (F.col("_zone").isNotNull() & holds_wanted("_zn"))).drop("_zn")
    bounds = ["_least", "_largest", "_before"]
    rows, cells, most = counted, [*keys, "_zone"], None
    while True:
        opened = materialize(opened, "opened-values")
        last, most = most, opened.agg(F.max("_in")).first()[0] or 0
        if most <= MOST_SORTED or most == last:
            break
        part = f"_part{len(cells)}"
        inside = _join(rows, opened.drop("_in"), cells, [*bounds, *stats]).withColumn(part, part_of(v, F.col("_least"), F.col("_largest")))
        parts = inside.groupBy(*cells, part).agg(
            F.sum("_n").alias("_pn"),
            F.count(v).alias("_in"),
            F.min(v).alias("_least"),
            F.max(v).alias("_largest"),
            F.first("_before").alias("_start"),
            *[F.first(s).alias(s) for s in stats],
        )
        before = F.col("_start") + _count_before(F.col("_pn"), Window.partitionBy(*cells), part)
        rows = inside.drop(*bounds, *stats)
        opened = parts.withColumn("_before", before).filter((F.col("n_values") == 0) | holds_wanted("_pn")).drop("_pn", "_start")
        cells = [*cells, part]

    rows = _join(rows, opened, cells, ["_before", *stats])
    inner = Window.partitionBy(*cells).orderBy(v.asc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_last", F.col("_before") + F.sum("_n").over(inner) - 1)
    ranked = ranked.withColumn("_first", F.col("_last") - F.col("_n") + 1)
    picks = []
    for name, p in percentiles.items():
        for side, rank in zip(("lo", "hi"), ranks(p)):
            hit = v.isNotNull() & (rank >= F.col("_first")) & (rank <= F.col("_last"))
            picks.append(F.max(F.when(hit, v.cast("double"))).alias(f"_{side}_{name}"))
    final = ranked.groupBy(*keys).agg(*[F.first(s).alias(s) for s in stats], *picks)
    low, high = (lambda name: F.col(f"_lo_{name}")), (lambda name: F.col(f"_hi_{name}"))
    return final.select(
        *keys,
        *stats,
        *[
            # Equal neighbours are taken as they are; infinite ones have no difference.
            F.when(low(name) == high(name), low(name)).otherwise(low(name) + (high(name) - low(name)) * ranks(p)[2]).alias(name)
            for name, p in percentiles.items()
        ],
    )


def _count_before(count: Column, group, order: str) -> Column:
    before = group.orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(before), F.lit(0))


def _join(rows: DataFrame, cells: DataFrame, on: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Rows of the given cells, with columns of the cell. NULL keys meet each other."""
    side = cells.select(*[F.col(c).alias(f"_o_{i}") for i, c in enumerate(on)], *carried)
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{i}"))
    return rows.join(side, same).drop(*[f"_o_{i}" for i in range(len(on))])


def approximate_percentiles(df: DataFrame, keys: Sequence[str], value: str, percentiles: Mapping[str, float], accuracy: int = 10000) -> DataFrame:
    """Same columns from Spark's bounded-memory sketch, within 1/accuracy of the true rank."""
    return df.groupBy(*keys).agg(
        *[F.percentile_approx(value, F.lit(p), F.lit(accuracy)).alias(name) for name, p in percentiles.items()]
    )
