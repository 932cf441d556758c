"""Quality rules by host.

Every document is measured by itself. The failures of each rule are then added up by host, the rate of
each host is drawn towards the rate of all hosts by a beta prior fitted to the hosts themselves, and a
host whose shrunk rate of any rule is above the limit, and above the rate of all hosts, is rejected with all
its documents.

Only column expressions are used. A text is measured inside its own row, so no word is shuffled; what
is shuffled is one small row of sums for each host and task.

Defined results: a null text has no words and fails the base rule. A null host is no host, so it gets no
verdict and its documents stand by themselves. Repeated rows are separate documents and all count.
An empty table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import SPACES_RE, stored

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Bits of a packed number that hold the place; a string has fewer words than that.
PLACE_BITS = 30
#: Rules whose failures are added up by host.
RULES = ("base", "symbols", "dup_lines")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each text, and ``fails_<rule>``, to ``docs`` (whose columns must not have these names).

    Three-word windows are found twice in two steps. First 34 bits of each window's hash and its place
    share one number, so that sorting numbers puts equal windows side by side; places are kept whose
    bits meet. Then those few are compared again by their whole 64-bit hash.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_words", F.filter(F.split(t, SPACES_RE), lambda w: w != ""))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    window = lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))
    heads = F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0)))
    packed = F.transform(heads, lambda w, i: F.shiftleft(window(w, i), PLACE_BITS).bitwiseOR(i.cast("long")))
    d = d.withColumn("_packed", F.sort_array(packed))
    meets = lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0
    both = F.transform("_packed", lambda x, i: F.when(meets(x, F.get("_packed", i + 1)), F.array(x, F.get("_packed", i + 1))))
    places = F.transform(F.array_distinct(F.flatten(F.array_compact(both))), lambda x: x.bitwiseAND(2**PLACE_BITS - 1).cast("int"))
    whole = F.transform(places, lambda p: F.struct(window(F.get("_words", p), p).alias("h"), p.alias("p")))
    d = d.withColumn("_whole", F.sort_array(whole))
    beside = lambda g, i: (g["h"] == F.get("_whole", i - 1)["h"]) | (g["h"] == F.get("_whole", i + 1)["h"])
    d = d.withColumn("_at", F.sort_array(F.array_compact(F.transform("_whole", lambda g, i: F.when(beside(g, i), g["p"])))))
    covered = F.transform("_at", lambda p, i: F.coalesce(F.least(F.lit(3), F.get("_at", i + 1) - p), F.lit(3)))
    d = d.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
            "_n_lines": F.size("_lines").cast("long"),
        }
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = d.withColumns(
        {
            "fails_base": F.col("base_failed").cast("long"),
            "fails_symbols": (100 * F.col("n_symbols") > 10 * F.col("word_chars")).cast("long"),
            "fails_dup_lines": (100 * F.col("n_dup_lines") > 30 * F.col("_n_lines")).cast("long"),
        }
    )
    return d.drop("_words", "_lines", "_packed", "_whole", "_at", "_n_lines")


def host_verdicts(measured: DataFrame, host: str, max_rate: float = 0.8) -> DataFrame:
    """One row per host: documents, failures and shrunk rate of each rule, and ``host_rejected``: whether a
    shrunk rate is above ``max_rate`` and the host fails more often than all hosts together.

    The prior of a rule is a beta distribution with the mean of all documents and the strength that the
    spread between hosts implies (one-way analysis of variance on the failures). Equal hosts give an
    endless strength: every host then has the common rate. A single host, or hosts of one document
    each, tell nothing about the spread and are treated the same way.
    """
    hosts = (
        measured.filter(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n"), *[F.sum(f"fails_{r}").alias(f"f_{r}") for r in RULES])
    )
    hosts = stored(hosts, "host-sums")
    n, total, groups = F.col("n"), F.sum("n"), F.count("*")
    sums = [total.alias("docs"), groups.alias("hosts"), F.sum(n * n / F.lit(1.0)).alias("nn")]
    for r in RULES:
        f = F.col(f"f_{r}")
        sums += [F.sum(f).alias(f"t_{r}"), F.sum(f * f / n).alias(f"q_{r}")]
    prior = hosts.agg(*sums)
    out = hosts.join(F.broadcast(prior))  # one row
    rejected = []
    for r in RULES:
        out = out.withColumn(f"rate_{r}", _shrunk(r))
        rejected.append((F.col(f"rate_{r}") > max_rate) & (F.col(f"f_{r}") / n > F.col(f"t_{r}") / F.col("docs")))
    out = out.withColumn("host_rejected", reduce(lambda a, b: a | b, rejected))
    return out.select("host", "n", *[f"f_{r}" for r in RULES], *[f"rate_{r}" for r in RULES], "host_rejected")


def _shrunk(rule: str) -> Column:
    f, n, docs, hosts = F.col(f"f_{rule}"), F.col("n"), F.col("docs"), F.col("hosts")
    mean = F.col(f"t_{rule}") / docs
    between = F.try_divide(F.col(f"q_{rule}") - F.col(f"t_{rule}") * mean, hosts - 1)
    within = F.try_divide(F.col(f"t_{rule}") - F.col(f"q_{rule}"), docs - hosts)
    size = F.try_divide(docs - F.col("nn") / docs, hosts - 1)
    alike = F.try_divide(between - within, between + (size - 1) * within)  # correlation inside a host
    # rate = (f + s * mean) / (n + s) with strength s = 1 / alike - 1, written without dividing by alike
    pulled = F.try_divide(f * alike + (1 - alike) * mean, n * alike + (1 - alike))
    spread = (hosts > 1) & (docs > hosts) & (alike > 0)
    return F.when(spread, F.when(alike >= 1, f / n).otherwise(pulled)).otherwise(mean)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.8) -> DataFrame:
    """Measures and verdict of every row of ``docs``: doc_id, the measures, ``base_failed``, ``kept``,
    ``host_rejected``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("_text"))
    measured = stored(with_measures(rows, "_text").drop("_text"), "measures")
    verdicts = stored(host_verdicts(measured, "host", max_rate).select("host", "host_rejected"), "verdicts")
    bad = F.coalesce(F.col("host_rejected"), F.lit(False))
    return measured.join(verdicts, "host", "left").select("doc_id", *MEASURES, (~F.col("base_failed") & ~bad).alias("kept"), bad.alias("host_rejected"))


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged. The texts are measured twice, once for the
    hosts and once for the verdict, so that no text is shuffled while the verdicts are small."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(host).cast("string").alias("host"), F.col(text).alias("_text"))
    flags = with_measures(rows.select("host", "_text"), "_text").drop("_text")
    verdicts = stored(host_verdicts(flags, "host", max_rate).filter("host_rejected").select("host"), "verdicts")
    # A filter sinks below a projection of deterministic columns by repeating their expressions; a row number keeps it above.
    measured = with_measures(rows, "_text").withColumn("_nth", F.monotonically_increasing_id())
    passed = measured.filter(~F.col("base_failed") & (F.col("_nth") >= 0))
    return passed.join(verdicts, "host", "left_anti").select("_row.*")
