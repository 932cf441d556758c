"""Comparing the responses of two agents to the same question.

Every response of one agent pairs with every response of the other, so the number of pairs grows
with the square of the runs. Neither operator here builds those pairs: averages over all of them
follow from sums per question, and the pairs with the largest latency gap lie at the extremes of
each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.functions.exprs import AgentPair, pct_change, round_half
from tracegauge.operators.ordering import ranked_head
from tracegauge.operators.scratch import materialize
from tracegauge.operators.usage import attribute_usage, logged_usage, token_totals

TOKEN_COLUMNS = ["prompt_tokens", "completion_tokens", "total_tokens"]


def roots_of(spans: DataFrame, agent: str) -> DataFrame:
    return spans.filter((F.col("agent_name") == agent) & (F.col("span_type") == "record_root"))


def side_usage(spans: DataFrame, pair: AgentPair, side: str, lenient: bool = False) -> DataFrame:
    """Agent A reports tokens as attributes, agent B only inside its call logs."""
    return attribute_usage(spans, pair.a) if side == "a" else logged_usage(spans, pair.b, lenient)


def _side_sums(spans: DataFrame, pair: AgentPair, side: str) -> DataFrame:
    agent = pair.a if side == "a" else pair.b
    roots = (
        roots_of(spans, agent)
        .filter(F.col("user_query").isNotNull())
        .groupBy("user_query", "record_id")
        .agg(F.count(F.lit(1)).alias("m"), F.sum("duration_ms").alias("lat_s"), F.count("duration_ms").alias("lat_n"))
    )
    joined = roots.join(token_totals(side_usage(spans, pair, side)), "record_id", "left")
    sums = [F.sum("m").alias(f"{side}_m"), F.sum("lat_s").alias(f"{side}_lat_s"), F.sum("lat_n").alias(f"{side}_lat_n")]
    for c in TOKEN_COLUMNS:
        sums.append(F.sum(F.col(c) * F.col("m")).alias(f"{side}_{c}_s"))
        sums.append(F.sum(F.when(F.col(c).isNotNull(), F.col("m")).otherwise(0)).alias(f"{side}_{c}_n"))
    return joined.groupBy("user_query").agg(*sums)


def pair_averages(spans: DataFrame, pair: AgentPair = AgentPair()) -> DataFrame:
    """One row: averages over all pairs of responses to the same question.

    In the pair list each A value of a question repeats once per B response and the other way
    round, so its weight is the other side's response count.
    """
    q = _side_sums(spans, pair, "a").join(_side_sums(spans, pair, "b"), "user_query")

    def pair_avg(side: str, what: str) -> Column:
        other = F.col(f"{'b' if side == 'a' else 'a'}_m").cast("double")
        total = F.sum(F.col(f"{side}_{what}_s").cast("double") * other)
        return total / F.nullif(F.sum(F.col(f"{side}_{what}_n") * other), F.lit(0.0))

    # A difference exists only where both latencies do.
    diff = F.sum(
        F.col("a_lat_s").cast("double") * F.col("b_lat_n") - F.col("b_lat_s").cast("double") * F.col("a_lat_n")
    ) / F.nullif(F.sum(F.col("a_lat_n").cast("double") * F.col("b_lat_n")), F.lit(0.0))
    raw = q.agg(
        pair_avg("a", "lat").alias("a_lat"),
        pair_avg("b", "lat").alias("b_lat"),
        diff.alias("lat_diff"),
        *[pair_avg(s, c).alias(f"{s}_{c}") for s in "ab" for c in TOKEN_COLUMNS],
    )
    return raw.select(
        round_half(F.col("a_lat"), 4).alias("a_latency_ms"),
        round_half(F.col("b_lat"), 4).alias("b_latency_ms"),
        round_half(F.col("lat_diff"), 4).alias("latency_diff_ms"),
        pct_change(F.col("a_lat"), F.col("b_lat")).alias("latency_diff_pct"),
        *[round_half(F.col(f"{s}_{c}"), 4).alias(f"avg_{s}_{c}") for c in reversed(TOKEN_COLUMNS) for s in "ab"],
        pct_change(F.col("a_total_tokens"), F.col("b_total_tokens")).alias("token_diff_pct"),
    )


def widest_pairs(spans: DataFrame, top: int, pair: AgentPair = AgentPair()) -> DataFrame:
    """The ``top`` response pairs with the largest latency gap, in the order (gap descending,
    question, record of A, record of B), with previews, percentages and token counts.

    Exact for every ``top``:
    * only the ``top`` questions with the widest range can contribute, because each wider question
      has a pair that comes first;
    * inside a question, a pair of the i-th largest and the j-th smallest has i*j - 1 pairs before
      it, so only pairs with i*j <= top are formed.
    """
    sides = {
        s: roots_of(spans, agent)
        .filter(F.col("user_query").isNotNull() & F.col("duration_ms").isNotNull())
        .select("user_query", "record_id", "duration_ms", "agent_output")
        for s, agent in (("a", pair.a), ("b", pair.b))
    }
    lat = F.col("duration_ms")
    ranges = {s: df.groupBy("user_query").agg(F.min(lat).alias(f"{s}_min"), F.max(lat).alias(f"{s}_max"), F.count(lat).alias(f"{s}_n")) for s, df in sides.items()}
    widest = F.greatest(F.col("a_max") - F.col("b_min"), F.col("b_max") - F.col("a_min"))
    questions = materialize(
        ranges["a"].join(ranges["b"], "user_query").orderBy(widest.desc(), F.col("user_query").asc()).limit(top).select("user_query", "a_n", "b_n"),
        "widest-questions",
    )

    def extremes(side: str, largest: bool) -> DataFrame:
        # At most `top` questions, so the broadcast is bounded by the caller's parameter.
        rows = sides[side].join(F.broadcast(questions), "user_query")
        order = lat.desc() if largest else lat.asc()
        w = Window.partitionBy("user_query").orderBy(order, F.col("record_id").asc())
        return rows.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= top).select(
            "user_query",
            F.col("_i").cast("bigint").alias(f"{side}_i"),
            F.col("b_n" if side == "a" else "a_n").alias("_others"),
            F.col("record_id").alias(f"{side}_record_id"),
            lat.alias(f"{side}_latency_ms"),
            F.left("agent_output", F.lit(200)).alias(f"{side}_response_preview"),
        )

    def candidates(a_largest: bool) -> DataFrame:
        # The j-th row of the other side is wanted for every j up to top / i, so only those pairs are formed.
        partners = F.sequence(F.lit(1).cast("bigint"), F.least(F.floor(F.lit(top) / F.col("a_i")), "_others"))
        left = extremes("a", a_largest).withColumn("b_i", F.explode(partners)).drop("_others")
        joined = left.join(extremes("b", not a_largest).drop("_others"), ["user_query", "b_i"])
        ahead = F.col("a_latency_ms") >= F.col("b_latency_ms") if a_largest else F.col("a_latency_ms") < F.col("b_latency_ms")
        return joined.filter(ahead).drop("a_i", "b_i")

    gap = F.abs(F.col("a_latency_ms") - F.col("b_latency_ms"))
    order = [gap.desc(), F.col("user_query").asc(), F.col("a_record_id").asc(), F.col("b_record_id").asc()]
    head = materialize(ranked_head(candidates(True).unionByName(candidates(False)), order, top), "widest-pairs")

    for s in "ab":
        usage = side_usage(spans, pair, s)
        wanted = head.select(F.col(f"{s}_record_id").alias("record_id")).distinct()
        totals = token_totals(usage.join(F.broadcast(wanted), "record_id", "left_semi"))
        head = head.join(totals.select(F.col("record_id").alias(f"{s}_record_id"), *[F.col(c).alias(f"{s}_{c}") for c in TOKEN_COLUMNS]), f"{s}_record_id", "left")
    return head.select(
        "rank",
        "user_query",
        "a_record_id",
        "b_record_id",
        "a_response_preview",
        "b_response_preview",
        "a_latency_ms",
        "b_latency_ms",
        (F.col("a_latency_ms") - F.col("b_latency_ms")).alias("latency_diff_ms"),
        pct_change(F.col("a_latency_ms"), F.col("b_latency_ms")).alias("latency_diff_pct"),
        *[f"{s}_{c}" for s in "ab" for c in TOKEN_COLUMNS],
        (F.col("a_total_tokens") - F.col("b_total_tokens")).alias("token_diff"),
        pct_change(F.col("a_total_tokens"), F.col("b_total_tokens")).alias("token_diff_pct"),
    ).orderBy("rank")


def response_statistics(spans: DataFrame, pair: AgentPair = AgentPair()) -> DataFrame:
    """Side by side per question: response counts, latency and token averages of both agents, their
    differences, and the latest answer of each. One row stands for all pairs of the question.

    The span table is read three times: the roots of both agents, and the token rows of each. All meet in
    one grouping by record, and the sides are told apart by conditional sums.
    """
    sides = F.when(F.col("agent_name") == pair.a, "a").otherwise("b")
    of_both = spans.filter(F.col("agent_name").isin(pair.a, pair.b) & (F.col("span_type") == "record_root") & F.col("user_query").isNotNull())
    # The newest answer: a NULL time counts as the newest, ties go to the larger record.
    newest = F.struct(F.coalesce(F.unix_micros(F.col("end_ts").cast("timestamp")), F.lit(2**62)).alias("at"), "record_id", F.left("agent_output", F.lit(200)).alias("shown"))
    no_tokens = [F.lit(None).cast("bigint").alias(c) for c in TOKEN_COLUMNS]
    roots = of_both.groupBy(sides.alias("side"), "record_id", "user_query").agg(
        F.count(F.lit(1)).alias("m"), F.sum("duration_ms").alias("lat_s"), F.count("duration_ms").alias("lat_n"), F.max(newest).alias("newest")
    )
    rows = roots.select("*", *no_tokens)
    for side in "ab":
        empty = [F.lit(None).cast(roots.schema[c].dataType).alias(c) for c in ("user_query", "m", "lat_s", "lat_n", "newest")]
        totals = token_totals(side_usage(spans, pair, side)).filter(F.col("record_id").isNotNull())
        rows = rows.unionByName(totals.select(F.lit(side).alias("side"), "record_id", *empty, *TOKEN_COLUMNS))
    record = Window.partitionBy("side", "record_id")
    known = F.col("record_id").isNotNull()
    whole = rows.withColumns({c: F.when(known, F.sum(c).over(record)) for c in TOKEN_COLUMNS}).filter(F.col("user_query").isNotNull())

    def sums(side: str) -> list[Column]:
        own = F.col("side") == side
        found = [F.sum(F.when(own, F.col(c))).alias(f"{side}_{c}") for c in ("m", "lat_s", "lat_n")]
        for c in TOKEN_COLUMNS:
            found.append(F.sum(F.when(own, F.col(c) * F.col("m"))).alias(f"{side}_{c}_s"))
            found.append(F.sum(F.when(own & F.col(c).isNotNull(), F.col("m")).otherwise(0)).alias(f"{side}_{c}_n"))
        return [*found, F.max(F.when(own, F.col("newest")))["shown"].alias(f"{side}_response_preview")]

    q = whole.groupBy("user_query").agg(*sums("a"), *sums("b")).filter(F.col("a_m").isNotNull() & F.col("b_m").isNotNull())

    def mean(side: str, what: str) -> Column:
        return F.col(f"{side}_{what}_s").cast("double") / F.nullif(F.col(f"{side}_{what}_n"), F.lit(0))

    return q.select(
        "user_query",
        "a_response_preview",
        "b_response_preview",
        F.col("a_m").alias("a_responses"),
        F.col("b_m").alias("b_responses"),
        (F.col("a_m") * F.col("b_m")).alias("pairs"),
        round_half(mean("a", "lat"), 1).alias("a_latency_ms"),
        round_half(mean("b", "lat"), 1).alias("b_latency_ms"),
        round_half(mean("a", "lat") - mean("b", "lat"), 1).alias("latency_diff_ms"),
        pct_change(mean("a", "lat"), mean("b", "lat")).alias("latency_diff_pct"),
        *[round_half(mean(s, c), 2).alias(f"{s}_{c}") for s in "ab" for c in TOKEN_COLUMNS],
        round_half(mean("a", "total_tokens") - mean("b", "total_tokens"), 2).alias("token_diff"),
        pct_change(mean("a", "total_tokens"), mean("b", "total_tokens")).alias("token_diff_pct"),
    )
