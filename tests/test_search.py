import math
import random
import re
from collections import Counter

import pytest

from tracegauge.operators import search as S
from tracegauge.operators.search import group_hits, search


def brute_force(docs, queries, k):
    """BM25 of every query against every document."""
    words = {d: re.findall(r"\w+", (t or "").lower()) for d, t in docs}
    n, avg = len(words), sum(map(len, words.values())) / max(len(words), 1)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, text in queries:
        scores = {}
        for d, ws in words.items():
            tf = Counter(ws)
            s = sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (S.K1 + 1) / (tf[t] + S.K1 * (1 - S.B + S.B * len(ws) / avg))
                for t in set(re.findall(r"\w+", text.lower()))
                if tf[t]
            )
            if any(tf[t] for t in set(re.findall(r"\w+", text.lower()))):
                scores[d] = round(s, 6)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def run(spark, docs, queries, k):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(queries, "item_id bigint, text string")
    got = {i: [] for i, _ in queries}
    for r in search(d, q, k).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    return got


def same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(300)]
    docs = []
    for i in range(400):
        ws = [rnd.choice(common) for _ in range(rnd.randrange(1, 60))] + [rnd.choice(rare) for _ in range(rnd.randrange(0, 25))]
        rnd.shuffle(ws)
        docs.append((i, " ".join(ws)))
    docs += [(1000 + i, docs[7][1]) for i in range(130)]  # a group of copies
    docs += [(2000, ""), (2001, None), (2002, "The THE the.")]
    queries = [(i, " ".join([rnd.choice(common) for _ in range(8)] + [rnd.choice(rare) for _ in range(rnd.randrange(1, 9))])) for i in range(25)]
    queries += [(100, docs[7][1]), (101, "the"), (102, "nothing-here zzz"), (103, "w1 w1 w1 w2")]
    return docs, queries


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_equals_exhaustive_scoring(spark, corpus, k):
    docs, queries = corpus
    same(run(spark, docs, queries, k), brute_force(docs, queries, k))


@pytest.mark.parametrize("share", [0.0, 0.99])
def test_pruning_share_does_not_change_results(spark, corpus, share, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(S, "LOOKUP_SHARE", share)
    same(run(spark, docs, queries, 5), brute_force(docs, queries, 5))


def test_without_broadcast(spark, corpus, monkeypatch):
    from tracegauge.operators import scratch

    docs, queries = corpus
    monkeypatch.setattr(S, "measured_side", lambda df: scratch.measured_side(df, limit=0))
    same(run(spark, docs, queries, 5), brute_force(docs, queries, 5))


def test_filter_applies_before_scoring(spark, corpus):
    docs, queries = corpus
    part = [d for d in docs if d[0] % 2]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").filter("doc_id % 2 = 1")
    got = {}
    for r in search(d, spark.createDataFrame(queries, "item_id bigint, text string"), 3).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.doc_id
    want = brute_force(part, queries, 3)
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == {q: [d for d, _ in hits] for q, hits in want.items() if hits}


def test_grouped_hits(spark):
    hits = spark.createDataFrame([(1, r, 10 * r, "same" if r < 6 else "else") for r in range(1, 8)], "query_id int, rank int, doc_id int, text string")
    got = {r.text: (r.n_hits, r.best_rank, r.first_id, r.example_ids) for r in group_hits(hits, "text").collect()}
    assert got == {"same": (5, 1, 10, "10,20,30"), "else": (2, 6, 60, "60,70")}
