"""Column expressions shared by the reports. All of them stay inside generated JVM code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Averages of doubles may differ in the last bits with the order in which partial sums arrive.
# Differences below this are no difference.
FLOAT_NOISE = 1e-12


@dataclass(frozen=True)
class AgentPair:
    """The two agents under comparison and the short labels used in verdict columns."""

    a: str = "AGENT_A"
    b: str = "AGENT_B"
    label_a: str = "A"
    label_b: str = "B"
    display_a: str = "Agent A"
    display_b: str = "Agent B"


@dataclass(frozen=True)
class BucketLabels:
    """Score bucket labels, best first, for 1, 0.8, 0.6, 0.4 and the rest."""

    perfect: str
    high: str
    middle: str
    low: str
    poor: str

    def in_order(self) -> tuple[str, ...]:
        return (self.perfect, self.high, self.middle, self.low, self.poor)


# The two label sets the reports print.
REPORT_BUCKETS = BucketLabels("1.0 (Perfect)", "0.8-0.99", "0.6-0.79", "0.4-0.59", "< 0.4 (Poor)")
DASHBOARD_BUCKETS = BucketLabels("1.0 Perfect", "0.8 - 0.99", "0.6 - 0.79", "0.4 - 0.59", "< 0.4")

# One agent's evaluator names a metric differently.
METRIC_ALIASES = {"answer_correctness": "correctness"}


def elapsed_ms(start: Column, end: Column) -> Column:
    """Millisecond boundaries crossed between two instants."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def round_half(value: Column, digits: int) -> Column:
    """Round half away from zero on the decimal value, returned as double."""
    return F.round(value.cast("decimal(28,9)"), digits).cast("double")


def share_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return round_half(part / F.nullif(whole, F.lit(0)).cast("double") * 100, digits)


def pct_change(value: Column, base: Column, digits: int = 1) -> Column:
    """Difference in percent of the base; NULL where the base is 0."""
    return round_half((value - base) / F.nullif(base, F.lit(0)).cast("double") * 100, digits)


def score_bucket(score: Column, labels: BucketLabels = REPORT_BUCKETS) -> Column:
    """First matching label; a NULL score falls to the last one, a score above 1 to the second."""
    return (
        F.when(score == 1.0, labels.perfect)
        .when(score >= 0.8, labels.high)
        .when(score >= 0.6, labels.middle)
        .when(score >= 0.4, labels.low)
        .otherwise(labels.poor)
    )


def winner(a: Column, b: Column, label_a: str, label_b: str, tie: str = "TIE") -> Column:
    """Who is ahead; a missing side is a tie."""
    diff = a - b
    return F.when(diff > FLOAT_NOISE, label_a).when(diff < -FLOAT_NOISE, label_b).otherwise(tie)


def canonical_metric(metric: Column, aliases: dict[str, str] | None = None) -> Column:
    """Replace a metric name that equals an alias."""
    out = metric
    for name, target in (METRIC_ALIASES if aliases is None else aliases).items():
        out = F.when(metric == name, target).otherwise(out)
    return out


def replaced_metric(metric: Column, aliases: dict[str, str] | None = None) -> Column:
    """Replace an alias wherever it occurs inside the metric name (dashboard rule)."""
    out = metric
    for name, target in (METRIC_ALIASES if aliases is None else aliases).items():
        out = F.replace(out, F.lit(name), F.lit(target))
    return out


def display_name(agent: Column, pair: AgentPair, keep_unknown: bool = False) -> Column:
    label = F.when(agent == pair.a, pair.display_a).when(agent == pair.b, pair.display_b)
    return F.coalesce(label, agent) if keep_unknown else label


def preview(text: Column, length: int) -> Column:
    """Head of a text, with an ellipsis if something was left out."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def first_text(*texts: Column) -> Column:
    """First of the texts that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def looks_like_sql(text: Column) -> Column:
    return F.upper(text).contains("SELECT")


def range_band(score: Column) -> Column:
    """Band of a score under the ranges [0, .33], [.34, .66], [.67, 1], after rounding to 2 digits."""
    s = round_half(score, 2)
    return F.when(s.between(0, 0.33), "min").when(s.between(0.34, 0.66), "median").when(s.between(0.67, 1), "max")


def as_bigint(text: Column) -> Column:
    """``text.try_cast("bigint")``. Text that does not begin like a number is told by its first characters: a failed
    cast throws and catches an exception, which takes longer than all else that is done with a row."""
    return F.when(text.rlike(r"^[\x00-\x20\x7f]*[+-]?[0-9]"), text.try_cast("bigint"))
