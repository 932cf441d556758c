"""Repeated words and bytes against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegauge.llm.substring_dedup import cut_documents, dedup_words
from tracegauge.llm.suffix_dedup import dedup_bytes, repeated_starts
from tracegauge.llm.words import run_hashes, sliding_argmin


def removed(items, length, counts):
    gone = np.zeros(len(items), bool)
    for i in range(len(items) - length + 1):
        if counts[tuple(items[i : i + length])] > 1:
            gone[i : i + length] = True
    return gone


def brute(rows, length):
    counts = Counter(tuple(x[i : i + length]) for x in rows for i in range(len(x) - length + 1))
    return [removed(x, length, counts) for x in rows]


def corpus(seed, n=60):
    rnd = random.Random(seed)
    fresh = lambda k: [rnd.choice("abcdefghij") + str(rnd.randrange(60)) for _ in range(k)]
    passage, texts = fresh(50), [None, "", " \n ", "x " * 90, "short one"]
    for _ in range(n):
        w = fresh(rnd.choice([0, 10, 60, 120]))
        kind = rnd.random()
        if kind < 0.4:
            at, a = rnd.randint(0, len(w)), rnd.randint(0, 20)
            w[at:at] = passage[a : a + rnd.choice([10, 34, 35, 36, 50])]
        texts.append(" ".join(w))
        if kind > 0.8:
            texts.append(" ".join(w))
            if len(w) > 50:
                w[len(w) // 2] = "changed"
                texts.append("\n" + "  ".join(w))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_words(docs_of, seed):
    texts = corpus(seed)
    words = [(t or "").encode().split() for t in texts]
    got = {r.doc_id: r for r in dedup_words(docs_of(texts)).collect()}
    for i, gone in enumerate(brute(words, 35)):
        kept = [w for w, g in zip(words[i], gone) if not g]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words[i]), gone.sum(), hashlib.sha256(b" ".join(kept)).hexdigest())
        if got[i].kept_text is not None:
            assert got[i].kept_text.encode().split() == kept


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(docs_of, seed):
    texts = corpus(seed) + ["a" * 700, "ab" * 300 + "é" * 150, "é" * 150, "q" * 199, "q" * 200]
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in dedup_bytes(docs_of(texts)).collect()}
    for i, gone in enumerate(brute(raw, 200)):
        kept = bytes(np.frombuffer(raw[i], np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw[i]), gone.sum(), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("places", [0, 3])
def test_bytes_of_hot_anchors(docs_of, monkeypatch, places):
    from tracegauge.llm import seeds

    monkeypatch.setattr(seeds, "HOT_PLACES", places)
    test_bytes(docs_of, 3)


def test_expansion_equals_counting():
    rnd = random.Random(1)
    for trial in range(150):
        length, letters, segments = rnd.choice([3, 5, 8, 20]), b"ab" if trial % 2 else b"abcdefgh", []
        for _ in range(rnd.randint(1, 6)):
            if segments and rnd.random() < 0.5:
                x = bytearray(rnd.choice(segments))
                if x and rnd.random() < 0.5:
                    x[rnd.randrange(len(x))] = rnd.choice(letters)
                segments.append(bytes(x[rnd.randint(0, 3) :]))
            else:
                segments.append(bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 60))))
        want = [np.flatnonzero(_starts(s, segments, length)).tolist() for s in segments]
        assert [x.tolist() for x in repeated_starts(segments, length)] == want


def _starts(s, segments, length):
    counts = Counter(x[i : i + length] for x in segments for i in range(len(x) - length + 1))
    return np.array([counts[s[i : i + length]] > 1 for i in range(len(s) - length + 1)], bool)


def test_run_hashes_and_argmin():
    items = np.random.default_rng(3).integers(0, 4, 500).astype(np.uint64)
    for size in (1, 5, 8, 9, 35):
        hashes, runs = run_hashes(items, size), [tuple(items[i : i + size]) for i in range(500 - size + 1)]
        assert len(hashes) == len(runs) and len(set(hashes.tolist())) == len(set(runs))
        assert [h for _, h in sorted(dict(zip(runs, hashes.tolist())).items())] == [hashes[runs.index(r)] for r in sorted(set(runs))]
        assert sliding_argmin(items, size).tolist() == [i + int(np.argmin(items[i : i + size])) for i in range(500 - size + 1)]


def test_stage_changes_only_the_text(docs_of):
    texts = corpus(4, 20)
    docs = docs_of(texts).withColumns({"k1": F.lit("clash"), "kept_text": F.lit(1)})
    out = cut_documents(docs)
    assert out.columns == docs.columns
    words = [(t or "").encode().split() for t in texts]
    for r in out.collect():
        gone = brute(words, 35)[r.doc_id]
        if not gone.any():
            assert r.text == texts[r.doc_id]
        else:
            assert r.text.encode().split() == [w for w, g in zip(words[r.doc_id], gone) if not g]


def test_empty_table(docs_of):
    docs = docs_of(["x"]).limit(0)
    assert dedup_words(docs).count() == 0 and dedup_bytes(docs).count() == 0 and cut_documents(docs).count() == 0
