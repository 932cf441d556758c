"""Model scorers: loads per worker, bounded batches, failing rows."""

import os

from pyspark.sql import functions as F

from tracegauge.operators import scoring
from tracegauge.operators.model_scorers import cut, model_scorer, scored


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(os.path.join(folder, f"{os.getpid()}-{len(os.listdir(folder))}"), "w"):
            return os.getpid()

    def score(model, statements, sources):
        return [float(model == os.getpid()) for _ in statements]

    df = spark.range(4000).repartition(16).select("id", F.lit("A sentence. Another one!").alias("r"), F.lit("source").alias("s"))
    scores = scoring.score_responses(df, "r", "s", ("id",), model_scorer(load, score), check_numbers=False)
    for _ in range(2):
        assert {r.score for r in scores.collect()} == {1.0}
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert loads and len(loads) == len(set(loads)) and len(loads) < 16


def test_batches_are_bounded():
    statements, sources = ["a" * n for n in (1, 5, 5, 30, 2, 2, 2)], ["b", None, "", "b", "b", "b", "b"]
    parts = list(cut(statements, sources, 3, 12))
    assert [x for p, _ in parts for x in p] == statements and [x for _, p in parts for x in p] == sources
    assert [len(p) for p, _ in parts] == [3, 1, 3]
    assert list(cut([], [], 3, 10)) == []


def test_failing_rows_alone_have_no_score(spark):
    calls = []

    def score(model, statements, sources):
        calls.append(len(statements))
        if "bad" in statements:
            raise RuntimeError("cannot read this")
        return [len(s) if s != "none" else None for s in statements]

    assert scored(score, None, ["a", "bad", "ccc", "none", "nan"], [""] * 5, 2) == [1.0, None, 3.0, None, 3.0]
    assert scored(lambda m, a, b: [1.0], None, ["a", "b"], ["", ""], 1) == [1.0, 1.0]
    turns = iter([RuntimeError("busy"), None])

    def busy_once(model, statements, sources):
        problem = next(turns)
        if problem:
            raise problem
        return [float("nan"), 2.0]

    assert scored(busy_once, None, ["a", "b"], ["", ""], 2) == [None, 2.0]


def test_responses_without_sentences_and_rows_without_scores(spark):
    def score(model, statements, sources):
        return [None if "?" in (s or "") else 1.0 for s in statements]

    rows = [(1, "Good.", "s"), (2, "", "s"), (3, None, "s"), (4, "Good. Odd?!", None)]
    df = spark.createDataFrame(rows, "id int, r string, s string")
    got = {r.id: (r.score, r.band) for r in scoring.score_responses(df, "r", "s", ("id",), model_scorer(dict, score), check_numbers=False).collect()}
    assert got == {1: (1.0, "max"), 2: (None, None), 3: (None, None), 4: (0.5, "median")}
