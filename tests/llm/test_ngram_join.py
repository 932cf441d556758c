"""The Jaccard join against all pairs, on generated groups of near copies."""

import random

import pytest
from pyspark.sql import functions as F

from tracegauge.llm.components import components
from tracegauge.llm.ngram_join import one_of_each, similar_documents


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    fresh = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage, texts = fresh(30), [None, "", "  ", "one two", "ONE two", "one two three four five", "One Two three four five"]
    while len(texts) < n:
        w = fresh(rnd.choice([4, 6, 20, 60, 150]))
        if rnd.random() < 0.5:
            w = passage + w
        texts.append(" ".join(w))
        for _ in range(rnd.choice([0, 0, 1, 5])):
            x = list(w)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                x[rnd.randrange(len(x))] = rnd.choice(vocabulary)
            texts.append(" ".join(x).upper() if rnd.random() < 0.1 else " ".join(x))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(docs_of, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_stage_keeps_one_of_each(docs_of):
    texts = corpus(3, 60)
    docs = docs_of(texts).withColumns({"k1": F.lit("clash"), "component": F.lit(1)})
    kept = one_of_each(docs.union(docs.filter("doc_id > 40")))
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    blank = [i for i, t in enumerate(texts) if not (t or "").strip()]
    assert ids == sorted({c for (n, c) in brute(texts) if n} | set(blank))


def test_ids_null_or_repeated(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (5, "q r s"), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (5, 1, 5), (None, 1, None)], key=str)
    assert one_of_each(docs).count() == 3


def test_empty_table(docs_of):
    docs = docs_of(["x"]).limit(0)
    assert similar_documents(docs).count() == 0 and one_of_each(docs).count() == 0


def copies(rnd, n, words, changes, base):
    out = [" ".join(base)] if changes < 3 else []
    while len(out) < n:
        x = list(base)
        for _ in range(changes):
            x[rnd.randrange(words)] = f"z{rnd.randrange(10**6)}"
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("changes", [2, 3])
def test_pairs_grow_with_the_rows_of_a_group(docs_of, monkeypatch, changes):
    """A group of near copies is joined by about one verified pair a row, not by all its links."""
    from tracegauge.llm import ngram_join

    tried, verified = [], ngram_join._verified

    def counting(pairs, sets, percent):
        tried.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "_verified", counting)
    for n in (200, 800):
        rnd, tried[:] = random.Random(n + changes), []
        texts = copies(rnd, n, 200, changes, [f"w{rnd.randrange(10**6)}" for _ in range(200)])
        found = {r.component_id for r in similar_documents(docs_of(texts)).collect()}
        if changes < 3:
            assert found == {0} and sum(tried) <= 2 * n
        else:
            assert sum(tried) <= 6 * n


def test_index_rows_leave_in_small_batches():
    import numpy as np
    import pyarrow as pa

    from tracegauge.llm import ngram_join as join

    n, draw = 2000, np.random.default_rng(3)
    size = draw.integers(50, 150, n)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(draw.integers(-(2**62), 2**62, size.sum())))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(size + draw.integers(0, 10, n)), lists], ["cid", "n", "shared"])
    out = [*join._index(80)(iter([batch]))]
    alone = [*join._index(80)(batch.slice(i, 1) for i in range(n))]
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches(alone))
    assert max(len(b.column(1).unique()) for b in out) <= 512


def test_shared_tokens_are_counted_in_one_shuffle(spark):
    from tracegauge.llm.ngram_join import _shared_tokens

    sets = spark.createDataFrame([(1, 3, [5, 2, 3]), (2, 2, [2, 3]), (3, 1, [3]), (4, 1, [9]), (5, 0, [])], "cid long, n long, tokens array<long>")
    shared = _shared_tokens(sets, "tokens")
    assert {r.cid: [tuple(x) for x in r.shared] for r in shared.collect()} == {1: [(2, 2), (3, 3)], 2: [(2, 2), (3, 3)], 3: [(3, 3)]}
    assert "Join" not in shared._jdf.queryExecution().optimizedPlan().toString()
