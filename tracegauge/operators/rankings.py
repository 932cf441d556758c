"""Whether a response lists things in the order in which its source ranks them.

The items of a response are matched by their label to the first place where an earlier turn lists it. Read in the
order of the response, these places must not go backwards. Neighbours of the source that carry one number are
tied: they share a place, so either may come first. Items that the source does not list say nothing about the order.

First places are computed once per conversation and label and then looked up, so no response is compared with
all turns before it. Lists are short parts of one text each; positions are counted within one turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.functions.text import numbers, sentences

#: Array of (label, number) of a text, in its order.
Items = Callable[[Column], Column]
MARKED = r"^\s*(?:[-*•]|[0-9]{1,3}[.)])\s+"
NUMBER_AT_END = r"[:=(–-]?\s*[-+]?[0-9][0-9.,]*\s*%?\)?\s*$"


def _item(text: Column, label: Column) -> Column:
    found = numbers(text)
    plain = F.array_join(F.regexp_extract_all(F.lower(label), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    return F.struct(F.nullif(plain, F.lit("")).alias("label"), F.try_element_at(found, F.lit(-1)).alias("number"))


def list_items(text: Column) -> Column:
    """Lines with a bullet or number in front: the label is what stands before the first colon, bracket or dash, or
    before a number at the end; the number is the last one of the line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(MARKED))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, MARKED, ""))
    return F.transform(bare, lambda x: _item(x, F.regexp_replace(F.regexp_replace(x, r"(?:[:(–|]|\s-\s).*$", ""), NUMBER_AT_END, "")))


def sentence_openers(text: Column) -> Column:
    """The first word of every sentence, with the sentence's last number."""
    return F.transform(sentences(text), lambda s: _item(s, F.regexp_extract(s, r"[\p{L}\p{N}]+", 0)))


def _listed(turns: DataFrame, conversation: str, turn: str, text: str, items: Items) -> DataFrame:
    listed = turns.select(conversation, turn, F.posexplode_outer(items(F.coalesce(text, F.lit("")))).alias("item_no", "item"))
    return listed.select(conversation, turn, "item_no", F.col("item.label").alias("label"), F.col("item.number").alias("number")).filter("label IS NOT NULL")


def ranking_orders(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    responder: str = "assistant",
    evidence_roles: tuple[str, ...] | None = None,
    items: Items = list_items,
) -> DataFrame:
    """One row per response: ``n_items``, ``n_ranked`` (items that an earlier turn lists), ``n_backwards`` (steps against the
    order of the source) and ``order_kept``, NULL where fewer than two items are ranked."""
    sources = turns.filter(F.col(role).isin(*evidence_roles) if evidence_roles else ~F.col(role).eqNullSafe(F.lit(responder)))
    of_turn = Window.partitionBy(conversation, turn).orderBy("item_no")
    before = F.lag("number").over(of_turn)
    # A run of equal numbers is one place of the ranking.
    starts = F.when(before.isNull() | F.col("number").isNull() | (before != F.col("number")), F.col("item_no"))
    places = _listed(sources, conversation, turn, text, items).withColumn("starts", starts)
    places = places.withColumn("place", F.last("starts", ignorenulls=True).over(of_turn.rowsBetween(Window.unboundedPreceding, 0)))
    first = places.groupBy(conversation, "label").agg(F.min(F.struct(turn, "place")).alias("first"))
    said = _listed(turns.filter(F.col(role) == responder), conversation, turn, text, items)
    # Both sides are exploded from texts, so Spark's size estimate is far too low to broadcast by.
    ranked = said.join(first.hint("merge"), [conversation, "label"], "left")
    known = F.when(F.col("first")[turn] < F.col(turn), F.col("first"))
    ranked = ranked.withColumn("known", known)
    last_known = F.last("known", ignorenulls=True).over(of_turn.rowsBetween(Window.unboundedPreceding, -1))
    steps = ranked.withColumn("backwards", F.coalesce(F.col("known") < last_known, F.lit(False)))
    counts = steps.groupBy(conversation, turn).agg(
        F.count(F.lit(1)).alias("n_items"), F.count("known").alias("n_ranked"), F.count_if("backwards").alias("n_backwards")
    )
    zero = F.lit(0).cast("bigint")
    responses = turns.filter(F.col(role) == responder).select(conversation, turn).distinct().join(counts, [conversation, turn], "left")
    filled = responses.withColumns({c: F.coalesce(c, zero) for c in ("n_items", "n_ranked", "n_backwards")})
    return filled.withColumn("order_kept", F.when(F.col("n_ranked") >= 2, F.col("n_backwards") == 0))
