"""Scoring of agent responses, with scorers that can be exchanged.

A scorer is any function ``(text, text) -> Column of double``: a built-in expression as below, or an
Arrow UDF (``pandas_udf``) that calls a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegauge.functions.exprs import range_band, round_half
from tracegauge.functions.text import ABSTENTIONS, is_abstention, is_question, numbers, rounded_forms, sentences, words
from tracegauge.operators.ordering import dealt, with_position

Scorer = Callable[[Column, Column], Column]
OVERLAP = 0.6
LETTERS = r"\p{L}+"


def token_f1(response: Column, truth: Column) -> Column:
    """F1 of the distinct words of two texts; NULL if either text is missing."""
    a, b = F.array_distinct(words(response)), F.array_distinct(words(truth))
    size = F.size(a) + F.size(b)
    return F.when(response.isNotNull() & truth.isNotNull(), F.when(size == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / size))


def word_overlap(statement: Column, source: Column) -> Column:
    """Share of the distinct words of a statement that occur in the source."""
    a = F.array_distinct(words(statement))
    return F.size(F.array_intersect(a, words(source))) / F.nullif(F.size(a), F.lit(0)).cast("double")


def score_correctness(responses: DataFrame, truths: DataFrame, on: str, response: str, truth: str, scorer: Scorer = token_f1) -> DataFrame:
    """Join responses to the ground truth of their question and score each; one without a ground truth
    stays, with a NULL score."""
    return responses.join(truths.select(on, truth), on, "left").withColumn("score", round_half(scorer(F.col(response), F.col(truth)), 4))


def score_statements(
    df: DataFrame, response: str, source: str, scorer: Scorer = word_overlap, threshold: float = OVERLAP, keep: tuple[str, ...] = (), check_numbers: bool = True
) -> DataFrame:
    """Sentence-level support of a response by a source in the same row, with any scorer: one row per
    sentence with ``supported`` 0/1. ``check_numbers`` also asks that every number of the sentence
    occurs in the source, up to rounding."""
    return _judged(df, response, source, scorer, threshold, keep, check_numbers).filter(F.col("sentence").isNotNull())


def _judged(df: DataFrame, response: str, source: str, scorer: Scorer, threshold: float, keep: tuple[str, ...], check_numbers: bool) -> DataFrame:
    """Sentences with ``supported``; a response without one stays as a row of NULLs."""
    rows = df.select(*keep, F.col(source).alias("_source"), F.posexplode_outer(sentences(F.col(response))).alias("sentence_no", "sentence"))
    s = F.col("sentence")
    backed = F.coalesce(scorer(s, F.col("_source")), F.lit(0.0)) >= threshold
    if check_numbers:
        backed = backed & numbers_backed(s, F.col("_source"))
    ok = is_abstention(s) | (~is_question(s) & backed)
    return rows.select(*keep, "sentence_no", "sentence", F.when(s.isNotNull(), ok.cast("int")).alias("supported"))


def score_responses(
    df: DataFrame, response: str, source: str, keys: tuple[str, ...], scorer: Scorer = word_overlap, threshold: float = OVERLAP, check_numbers: bool = True
) -> DataFrame:
    """Share of supported sentences per ``keys``, with its band. A response without a sentence has a NULL score."""
    scores = _judged(df, response, source, scorer, threshold, keys, check_numbers).groupBy(*keys).agg(round_half(F.avg("supported"), 4).alias("score"))
    return scores.withColumn("band", range_band(F.col("score")))


def _word_features(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0)), lambda w: F.concat(F.lit("w:"), w))


def _statement_features(sentence: Column) -> Column:
    """Words as ``w:...`` and numbers as ``n:...``, each once."""
    number = F.transform(numbers(sentence), lambda x: F.concat(F.lit("n:"), x))
    return F.array_distinct(F.concat(_word_features(sentence), number))


def _source_features(text: Column) -> Column:
    """As for statements, with every number also in its rounded forms."""
    number = F.transform(F.flatten(F.transform(numbers(text), rounded_forms)), lambda x: F.concat(F.lit("n:"), x))
    return F.array_distinct(F.concat(_word_features(text), number))


def numbers_backed(statement: Column, source: Column) -> Column:
    """Whether every number of a statement occurs in the source, up to rounding."""
    return F.size(F.array_except(numbers(statement), F.flatten(F.transform(numbers(F.coalesce(source, F.lit(""))), rounded_forms)))) == 0


def grounded_sentences(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", responder: str = "assistant", threshold: float = OVERLAP, evidence_roles: tuple[str, ...] | None = None, abstentions: tuple[str, ...] = ABSTENTIONS) -> DataFrame:
    """One row per sentence of every response, with ``supported`` 0/1 by the earlier turns of its
    conversation. Evidence are the turns of ``evidence_roles``, or all that are not the responder's own:
    saying a thing twice does not support it.

    A sentence is supported if at least ``threshold`` of its words and all of its numbers (up to
    rounding) occurred before, or if it admits a gap in the data; questions are not supported. Instead
    of gathering the earlier turns of each response, the first turn of every word of a conversation is
    computed once and compared with the turn of the sentence, so a long conversation is not collected.
    """
    # Outer explodes: an inner one makes Spark compute the list twice, the first time in a filter.
    evidence = turns.filter(F.col(role).isin(*evidence_roles) if evidence_roles else ~F.col(role).eqNullSafe(F.lit(responder)))
    features = evidence.select(conversation, turn, F.explode_outer(_source_features(F.coalesce(text, F.lit("")))).alias("feature"))
    first = features.groupBy(conversation, "feature").agg(F.min(turn).alias("_first"))
    split = turns.filter(F.col(role) == responder).select(conversation, turn, F.posexplode_outer(sentences(F.col(text))).alias("sentence_no", "sentence"))
    s = F.col("sentence")
    parts = split.filter(s.isNotNull()).select(
        conversation,
        turn,
        "sentence_no",
        is_abstention(s, abstentions).alias("_abstains"),
        is_question(s).alias("_asks"),
        F.explode_outer(_statement_features(s)).alias("feature"),
    )
    # Both sides are exploded from texts, so Spark's size estimate is far too low to broadcast by.
    matched = parts.join(first.hint("merge"), [conversation, "feature"], "left").withColumn("_hit", F.coalesce(F.col("_first") < F.col(turn), F.lit(False)))
    is_word, is_number = F.col("feature").startswith("w:"), F.col("feature").startswith("n:")
    counted = matched.groupBy(conversation, turn, "sentence_no").agg(
        F.count_if(is_word).alias("_words"),
        F.count_if(is_word & F.col("_hit")).alias("_word_hits"),
        F.count_if(is_number).alias("_numbers"),
        F.count_if(is_number & F.col("_hit")).alias("_number_hits"),
        F.bool_or("_abstains").alias("_abstains"),
        F.bool_or("_asks").alias("_asks"),
    )
    backed = (
        (F.col("_words") + F.col("_numbers") > 0)
        & (F.col("_word_hits") >= F.lit(threshold) * F.col("_words"))
        & (F.col("_number_hits") == F.col("_numbers"))
    )
    ok = F.col("_abstains") | (~F.col("_asks") & backed)
    return counted.select(conversation, turn, F.col("sentence_no").cast("bigint").alias("sentence_no"), ok.cast("int").alias("supported"))


def score_groundedness(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", responder: str = "assistant", **options) -> DataFrame:
    """Score of each response: supported sentences / all sentences, with its band. A response without a
    sentence stays, with a NULL score."""
    counts = (
        grounded_sentences(turns, conversation, turn, role=role, responder=responder, **options)
        .groupBy(conversation, turn)
        .agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("supported").cast("bigint").alias("n_supported"))
    )
    zero = F.lit(0).cast("bigint")
    scores = (
        turns.filter(F.col(role) == responder)
        .select(conversation, turn)
        .distinct()
        .join(counts, [conversation, turn], "left")
        .withColumns({"n_sentences": F.coalesce("n_sentences", zero), "n_supported": F.coalesce("n_supported", zero)})
        .withColumn("score", round_half(F.col("n_supported") / F.nullif(F.col("n_sentences"), zero).cast("double"), 4))
    )
    return scores.withColumn("band", range_band(F.col("score")))


#: Texts of a step that a trace document shows: what went in, what was asked, what came back.
STEP_TEXTS = ("user_query", "search_query", "analyst_sql", "retrieval_query", "planning_output", "call_return", "agent_output")
#: Characters of one line of a trace document; a longer one goes on in further pieces.
LINE_CHARS = 8192


def trace_documents(spans: DataFrame, steps_per_part: int = 100, line_chars: int = LINE_CHARS) -> DataFrame:
    """Each trace as one ordered document for trace-level scorers, with input, query and return of every
    step, in parts of ``steps_per_part`` steps.

    No text is cut away. The first ``line_chars`` characters of each step stand in piece 0 of its part,
    the next ones in piece 1, and so on, so that neither many steps nor a long return make a
    document larger than ``steps_per_part * line_chars`` characters.
    """
    rows = spans.filter((F.col("record_type") == "SPAN") & F.col("trace_id").isNotNull()).select(
        "trace_id", "agent_name", F.coalesce("span_type", "call_function", F.lit("step")).alias("step"), "metric", "start_ts", *STEP_TEXTS
    )
    order = ["step", *[F.col(c).asc_nulls_first() for c in ("metric", *STEP_TEXTS)]]
    placed = with_position(rows, ["trace_id"], "start_ts", order)
    texts = [F.when(F.col(c) != "", F.concat(F.lit(f"{c}: "), F.col(c))) for c in STEP_TEXTS]
    line = F.concat_ws(" | ", F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("step")), *texts)
    part = F.floor((F.col("position") - 1) / steps_per_part).cast("bigint")
    lines = placed.select("trace_id", part.alias("part"), "position", "agent_name", line.alias("line"))
    last = F.floor((F.greatest(F.length("line"), F.lit(1)) - 1) / line_chars).cast("bigint")
    pieces = lines.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    shown = F.substring("line", (F.col("piece") * line_chars + 1).cast("int"), F.lit(line_chars))
    mark = F.when(F.col("piece") > 0, F.concat(F.lit("["), F.col("position").cast("string"), F.lit("."), F.col("piece").cast("string"), F.lit("] "))).otherwise("")
    # A line has one piece as a rule; the pieces of long lines are not counted, they share the tasks.
    return (
        dealt(pieces.withColumn("line", F.concat(mark, shown)), rows.count(), "trace_id", "part", "piece")
        .groupBy("trace_id", "part", "piece")
        .agg(
            F.max("agent_name").alias("agent_name"),
            F.count(F.lit(1)).alias("n_steps"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("document"),
        )
    )


def score_documents(documents: DataFrame, measure: Callable[[Column], dict[str, Column]], finish: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """Trace-level score. ``measure`` gives named numbers of one document, these are added up over the
    parts of a trace, and ``finish`` makes the sums into a score. A score of sums does not depend on
    how a trace is cut into parts."""
    states = measure(F.col("document"))
    parts = documents.select("trace_id", *[c.alias(f"_s_{n}") for n, c in states.items()])
    sums = parts.groupBy("trace_id").agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in states])
    return sums.select("trace_id", round_half(finish({n: F.col(f"_s_{n}") for n in states}), 4).alias("score"), *[F.col(f"_s_{n}").alias(n) for n in states])


def to_event_rows(scores: DataFrame, agent: Column, run: Column, metric: Column, target: Column, score: Column, time: Column) -> DataFrame:
    """Scores in the form of event-table rows, ready to be appended to it."""
    attributes = F.to_json(
        F.struct(
            agent.alias("obs.agent.name"),
            run.alias("obs.run.name"),
            F.lit("eval_root").alias("obs.span_type"),
            metric.alias("obs.eval.metric_name"),
            target.alias("obs.eval.target_record_id"),
            score.alias("obs.eval.score"),
        )
    )
    return scores.select(
        F.lit("SPAN").alias("record_type"),
        time.cast("timestamp").alias("start_timestamp"),
        time.cast("timestamp").alias("timestamp"),
        F.lit(None).cast(T.StringType()).alias("trace"),
        F.lit(None).cast(T.StringType()).alias("record"),
        attributes.alias("record_attributes"),
    )


