import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracegauge.functions.exprs import range_band
from tracegauge.functions.text import sentences
from tracegauge.operators import scoring

T0 = datetime.datetime(2024, 1, 1)


def grounded(spark, *turns):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return [r.supported for r in scoring.grounded_sentences(df).orderBy("turn", "sentence_no").collect()]


def test_sentences(spark):
    df = spark.createDataFrame([("One. Two?  Three!\n- four 3.5\n\n 5",), ("",), (None,)], "t string")
    assert [r.s for r in df.select(sentences(F.col("t")).alias("s")).collect()] == [["One.", "Two?", "Three!", "- four 3.5", "5"], [], None]


@pytest.mark.parametrize(
    "said, supported",
    [
        ("The average score is 3.89.", 1),
        ("The average score is 3.9.", 1),
        ("The average score is 4.", 1),
        ("The average score is 3.8.", 0),
        ("The average score is 3.890.", 1),
        ("There is room for improvement.", 0),
        ("The average score?", 0),
        ("I don’t have numbers on refunds.", 1),
        ("...", 0),
        ("3.89", 1),
    ],
)
def test_support_rules(spark, said, supported):
    assert grounded(spark, ("user", "tool: the average score is 3.89 of 200"), ("assistant", said)) == [supported]


def test_only_earlier_turns_count(spark):
    assert grounded(spark, ("assistant", "red apples"), ("user", "red apples"), ("assistant", "red apples"), ("user", "pears")) == [0, 1]


def test_saying_it_twice_does_not_support_it(spark):
    said = "Revenue reached 777 dollars."
    assert grounded(spark, ("user", "how much?"), ("assistant", said), ("assistant", said)) == [0, 0]
    df = spark.createDataFrame([(1, 0, "user", "red pears"), (1, 1, "tool", "blue boats"), (1, 2, "assistant", "Red pears. Blue boats.")], "conv_id bigint, turn bigint, role string, text string")
    assert [r.supported for r in scoring.grounded_sentences(df, evidence_roles=("tool",)).orderBy("sentence_no").collect()] == [0, 1]


@pytest.mark.parametrize(
    "source, said, supported",
    [
        ("1,234", "1234", 1),
        ("1234567", "1,234,567", 1),
        ("3.1415926", "3.14159", 1),
        ("3.1415926", "3.14158", 0),
        ("-5", "5", 0),
        ("-5", "-5.0", 1),
        ("2020-2021", "2021", 1),
        ("9.995", "10", 1),
        ("0.05", "0.1", 1),
        ("7" * 50 + ".25", "7" * 50 + ".25", 1),
        ("007", "7", 1),
    ],
)
def test_numbers(spark, source, said, supported):
    assert grounded(spark, ("user", source), ("assistant", said)) == [supported]
    df = spark.createDataFrame([(said, source)], "r string, s string")
    assert scoring.score_statements(df, "r", "s", lambda a, b: F.lit(1.0)).first().supported == supported


def test_empty_response_stays_without_a_score(spark):
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", ""), (1, 2, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    assert sorted((r.turn, r.n_sentences, r.score, r.band) for r in scoring.score_groundedness(df).collect()) == [(1, 0, None, None), (2, 0, None, None)]


def test_response_without_ground_truth_stays(spark):
    responses, truths = (spark.createDataFrame(x, "q string, t string") for x in ([("a", "one"), ("b", "two")], [("a", "one")]))
    got = scoring.score_correctness(responses.withColumnRenamed("t", "r"), truths, "q", "r", "t").collect()
    assert {(x.q, x.score) for x in got} == {("a", 1.0), ("b", None)}


def test_score_and_band(spark):
    df = spark.createDataFrame([(1, 0, "user", "red apples"), (1, 1, "assistant", "Red apples. Blue boats. Red. Why?")], "conv_id bigint, turn bigint, role string, text string")
    r = scoring.score_groundedness(df).first()
    assert (r.n_sentences, r.n_supported, r.score, r.band) == (4, 2, 0.5, "median")


def test_bands(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 0.33, 0.334, 0.335, 0.664, 0.666, 1.0, None)], "s double")
    assert [r.b for r in df.select(range_band(F.col("s")).alias("b")).collect()] == ["min", "min", "min", "median", "median", "max", "max", None]


def test_token_f1(spark):
    df = spark.createDataFrame([("a b c", "A b d"), ("", ""), (None, "x"), ("x", "y")], "r string, t string")
    assert [r.f for r in df.select(scoring.token_f1(F.col("r"), F.col("t")).alias("f")).collect()] == [pytest.approx(2 / 3), 1.0, None, 0.0]


def test_arrow_scorer(spark):
    from pyspark.sql import types as T

    @F.pandas_udf(T.DoubleType())
    def starts_alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return (a.str[0] == b.str[0]).astype("float64")

    df = spark.createDataFrame([(1, "Red. Green.", "Roses")], "id int, r string, s string")
    got = scoring.score_statements(df, "r", "s", starts_alike, keep=("id",)).orderBy("sentence_no").collect()
    assert [r.supported for r in got] == [1, 0]


def test_long_trace_is_cut_into_ordered_parts(make_spans):
    rows = [
        {"record_type": "SPAN", "trace_id": "hot", "agent_name": "A", "span_type": f"s{i}", "agent_output": "x" * i, "start_ts": T0 + datetime.timedelta(seconds=7 * i)}
        for i in range(250)
    ] + [{"record_type": "LOG", "trace_id": "hot", "start_ts": T0}, {"record_type": "SPAN", "trace_id": None, "start_ts": T0}]
    docs = scoring.trace_documents(make_spans(rows).repartition(4), 100).orderBy("part").collect()
    assert [d.n_steps for d in docs] == [100, 100, 50]
    lines = "\n".join(d.document for d in docs).split("\n")
    assert lines[0] == "[1] s0" and lines[249] == "[250] s249 | agent_output: " + "x" * 249


def test_every_text_of_a_step_is_kept_and_long_ones_go_on(make_spans):
    step = {"record_type": "SPAN", "trace_id": "t", "agent_name": "A", "span_type": "s", "user_query": "in", "search_query": "q", "call_return": "r" * 50, "start_ts": T0}
    (whole,) = scoring.trace_documents(make_spans([step])).collect()
    assert whole.document == "[1] s | user_query: in | search_query: q | call_return: " + "r" * 50
    docs = scoring.trace_documents(make_spans([step, {**step, "start_ts": T0 + datetime.timedelta(seconds=1), "call_return": "z"}]), 100, 30).orderBy("piece").collect()
    assert all(len(d.document) <= 2 * 36 + 1 for d in docs)
    first = "".join(x.removeprefix(f"[1.{i}] ") for i, d in enumerate(docs) for x in d.document.split("\n") if x.startswith("[1"))
    assert first == whole.document


def test_trace_score_does_not_depend_on_the_parts(make_spans):
    rows = [
        {"record_type": "SPAN", "trace_id": "t", "span_type": "s", "agent_output": "x" if i % 100 == 0 else None, "start_ts": T0 + datetime.timedelta(seconds=i)} for i in range(101)
    ]

    def measure(document):
        lines = F.split(document, "\n")
        return {"shown": F.size(F.filter(lines, lambda x: x.contains(" | "))).cast("bigint"), "steps": F.size(lines).cast("bigint")}

    for steps in (1, 3, 100):
        docs = scoring.trace_documents(make_spans(rows), steps)
        assert scoring.score_documents(docs, measure, lambda s: s["shown"] / s["steps"].cast("double")).first().score == 0.0198
