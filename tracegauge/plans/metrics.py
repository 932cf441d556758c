"""Declarative metric layer: logical tables with dimensions, time dimensions, facts and metrics that
resolve by name or synonym and become one ``filter -> groupBy -> agg -> orderBy -> limit``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.operators.ordering import extreme_rows

GRAINS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Field:
    """A dimension or fact: a column expression over the base table. ``values`` lists an enumeration."""

    name: str
    expr: str | None = None
    synonyms: tuple[str, ...] = ()
    values: tuple[str, ...] = ()

    @property
    def sql(self) -> str:
        return self.expr or self.name


@dataclass(frozen=True)
class Metric:
    """An aggregate expression over dimensions and facts."""

    name: str
    expr: str
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class LogicalTable:
    name: str
    primary_key: tuple[str, ...] = ()
    dimensions: tuple[Field, ...] = ()
    time_dimensions: tuple[Field, ...] = ()
    facts: tuple[Field, ...] = ()
    metrics: tuple[Metric, ...] = ()

    def find(self, name: str, kinds: Sequence[str]) -> Field | Metric | None:
        """Member with this name, else the one with this synonym; case does not matter."""
        members = [m for kind in kinds for m in getattr(self, kind)]
        low = name.lower()
        exact = [m for m in members if m.name.lower() == low]
        hits = exact or [m for m in members if low in (s.lower() for s in m.synonyms)]
        if len(hits) > 1:
            raise ValueError(f"{name!r} is ambiguous in {self.name}: {', '.join(h.name for h in hits)}")
        return hits[0] if hits else None


@dataclass(frozen=True)
class MetricLayer:
    tables: tuple[LogicalTable, ...]
    verified: Mapping[str, Mapping] = field(default_factory=dict)


@dataclass(frozen=True)
class Condition:
    """``op`` is one of = <> < <= > >= in between like."""

    field: str
    op: str
    value: object

    def column(self, target: Column) -> Column:
        v = self.value
        if self.op == "in":
            return target.isin(*v)
        if self.op == "between":
            return target.between(*v)
        if self.op == "like":
            return target.like(v)
        plain = {
            "=": lambda: target == v,
            "<>": lambda: target != v,
            "<": lambda: target < v,
            "<=": lambda: target <= v,
            ">": lambda: target > v,
            ">=": lambda: target >= v,
        }
        if self.op not in plain:
            raise ValueError(f"unknown operator {self.op!r}")
        return plain[self.op]()


FIELDS = ("dimensions", "time_dimensions", "facts")


def resolve_table(layer: MetricLayer, metrics: Sequence[str], fields: Sequence[str]) -> LogicalTable:
    """The one table that has every name; metrics of different tables do not combine."""
    fits = [
        t
        for t in layer.tables
        if all(t.find(m, ("metrics",)) for m in metrics) and all(t.find(f, FIELDS) for f in fields)
    ]
    names = ", ".join([*metrics, *fields])
    if not fits:
        raise ValueError(f"no logical table has all of: {names}")
    if len(fits) > 1:
        raise ValueError(f"ambiguous, several logical tables have: {names}")
    return fits[0]


def metric_query(
    layer: MetricLayer,
    frames: Mapping[str, DataFrame],
    metrics: Sequence[str] = (),
    dimensions: Sequence[str] = (),
    time_grain: str | None = None,
    filters: Sequence[Condition] = (),
    order_by: Sequence[tuple[str, str]] = (),
    limit: int | None = None,
    facts: Sequence[str] = (),
) -> DataFrame:
    """Answer a metric question. ``frames`` maps logical table names to base DataFrames.

    Without metrics the named dimensions and facts are listed row by row. ``time_grain`` truncates
    the time dimensions asked for. ``order_by`` takes result columns with ``asc`` or ``desc``.
    """
    if time_grain is not None and time_grain not in GRAINS:
        raise ValueError(f"unknown time grain {time_grain!r}")
    table = resolve_table(layer, metrics, [*dimensions, *facts, *(c.field for c in filters)])
    measured = [table.find(m, ("metrics",)) for m in metrics]
    shown = [table.find(d, FIELDS) for d in [*dimensions, *facts]]
    times = {f.name for f in table.time_dimensions}

    base = frames[table.name].select(
        *[F.expr(f.sql).alias(f.name) for kind in FIELDS for f in getattr(table, kind)]
    )
    for condition in filters:
        target = table.find(condition.field, FIELDS)
        if target.values and condition.op in ("=", "<>", "in"):
            given = condition.value if condition.op == "in" else [condition.value]
            unknown = [v for v in given if v not in target.values]
            if unknown:
                raise ValueError(f"{target.name} has no value {unknown}")
        base = base.filter(condition.column(F.col(target.name)))

    def shown_column(f: Field) -> Column:
        if time_grain and f.name in times:
            return F.date_trunc(time_grain, F.col(f.name)).cast("date").alias(f.name)
        return F.col(f.name)

    if measured:
        result = base.groupBy(*[shown_column(f) for f in shown]).agg(*[F.expr(m.expr).alias(m.name) for m in measured])
    else:
        result = base.select(*[shown_column(f) for f in shown])
    if order_by:
        columns = []
        for name, direction in order_by:
            found = table.find(name, ("metrics", *FIELDS))
            c = F.col(found.name if found else name)
            columns.append(c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last())
        result = result.orderBy(*columns)
    return result if limit is None else result.limit(limit)


def verified_query(layer: MetricLayer, frames: Mapping[str, DataFrame], name: str) -> DataFrame:
    return metric_query(layer, frames, **layer.verified[name])


def duplicate_keys(layer: MetricLayer, frames: Mapping[str, DataFrame], table: str) -> DataFrame:
    """Primary-key values that occur more than once."""
    keys = next(t.primary_key for t in layer.tables if t.name == table)
    if not keys:
        raise ValueError(f"{table} declares no primary key")
    return frames[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def with_example(df: DataFrame, by: Sequence[str], aggregate: Column, example: str, time: str) -> DataFrame:
    """A metric per group with one example row: the earliest, then the one with the smallest id."""
    found = extreme_rows(df.withColumn("example", F.col(example)), by, time, example, ["example"], newest=False, extra=[aggregate])
    return found.select(*by, *[c for c in found.columns if c not in (*by, "example")], "example")
