"""Token counts, packing and merge-dropout against the tokenizer libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tracegauge.llm.merge_dropout import Encoder, Model, Skips, decode, encode, round_trip
from tracegauge.llm.packing import combinations, fullest, pack, pieces, sequences
from tracegauge.llm.pretokens import tokenizer
from tracegauge.llm.token_counts import token_counts

BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None,
    "",
    " ",
    "  two  spaces ",
    "it's we'll I'M don't 've",
    "a\n b\n\n c \n",
    "tab\there \tand\t there",
    "x<|endoftext|> y <|endoftext|>",
    "12 345 6,789.0 ½ Ⅷ ²",
    "é ü 日本語 𝒳 emoji 🎉 z",
    "nbsp here  wide 　 space​ zero",
    "odd \x1c \x1f\x85 spaces ﻿ bom",
    "no▁mark ▁ here",
    "word " * 3000,
    "w" * 5000,
]


@pytest.fixture(scope="module")
def ids_of():
    t = tokenizer(BPE)
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_counts_equal_the_library(docs_of, ids_of):
    for options in ({}, {"table_size": 5, "cache_size": 50, "limit": 3}):
        got = {r.doc_id: r for r in token_counts(docs_of(TEXTS), BPE, **options).collect()}
        for i, t in enumerate(TEXTS):
            assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(ids_of[i])), repr(t)[:40]
            assert got[i].over_limit == (len(ids_of[i]) > options.get("limit", 512))


def test_packing_is_lossless_and_tight(docs_of, ids_of):
    packed = pack(pieces(docs_of(TEXTS * 3), BPE, with_ids=True))
    rows = packed.collect()
    whole = [x + [2] for x in ids_of] * 3
    by_doc, by_bin = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in enumerate(whole):
        own = sorted(by_doc[i])
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == len(ids)
        assert all(n == 1024 for _, _, n in own[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))
    for own in by_bin.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and sum(own[-1]) <= 1024
    assert len(by_bin) <= -(-sum(map(len, whole)) // 1024) + 1
    texts = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in rows:
        assert texts[r.sequence_id][r.offset : r.offset + r.length] == whole[r.doc_id][r.start : r.start + r.length]


def test_fullest_combination():
    rnd = random.Random(5)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(1, 6))}
        capacity, sums = rnd.randint(1, 60), {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = fullest(counts, capacity)
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)
    plan = combinations({k: 1000 + k for k in range(1, 129)}, 128)
    used = {}
    for bins, chosen in plan:
        assert sum(k * n for k, n in chosen.items()) <= 128
        for k, n in chosen.items():
            used[k] = used.get(k, 0) + bins * n
    assert used == {k: 1000 + k for k in range(1, 129)} and len(plan) < 1000


def test_rate_zero_equals_the_library(docs_of):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r.ids for r in encode(docs_of(TEXTS), PIECES, dropout=0).collect()}
    for i, t in enumerate(TEXTS):
        if "▁" not in (t or ""):
            assert got[i] == sp.encode(t or "")


def test_dropout_varies_and_decodes(docs_of):
    docs = docs_of(TEXTS)
    seen = {}
    for seed in (1, 2):
        for r in decode(encode(docs, PIECES, dropout=0.3, seed=seed), PIECES).collect():
            assert r.decoded == (TEXTS[r.doc_id] or "")
            seen.setdefault(r.doc_id, set()).add(tuple(r.ids))
    again = {r.doc_id: tuple(r.ids) for r in encode(docs, PIECES, dropout=0.3, seed=2).collect()}
    assert all(again[i] in seen[i] for i in again)
    assert sum(len(x) == 2 for x in seen.values()) >= 6
    assert len(Model(PIECES).segment(" understanding")) < len(Model(PIECES).segment(" understanding", 2**63, 9))
    digests = round_trip(docs, PIECES).collect()
    assert {r.doc_id: r.n_chars for r in digests} == {i: len(t or "") for i, t in enumerate(TEXTS)}


def test_every_occurrence_has_its_own_skips(docs_of):
    texts = ["understanding " * 400] * 3
    rows = decode(encode(docs_of(texts), PIECES, dropout=0.3), PIECES).collect()
    assert all(r.decoded == texts[0] for r in rows) and len({tuple(r.ids) for r in rows}) == 3
    model, rate = Model(PIECES), int(0.3 * 2**64)
    skips = Skips(rate)
    units = model.units.findall(" " + texts[0])
    for cache_size in (1, 10, 1000):
        encoder, seen = Encoder(PIECES, 0.3, 7, cache_size), set()
        for document in (5, "x"):
            keys = skips.keys(xxhash.xxh3_64_intdigest(f"7 {document}"), len(units)).tolist()
            pieces = [model.segment(u, rate, k) for u, k in zip(units, keys)]
            assert encoder.packed(texts[0], document) == b"".join(map(model.packed, pieces))
            seen |= {tuple(p) for p in pieces}
        assert len(seen) > 20


def test_words_resume_at_their_first_skip():
    from itertools import combinations as subsets

    model = Model(PIECES)
    for unit in (" understanding", "  résumé", "aaaaaaa", " Straße日本", "\n", " x"):
        places = []
        pieces, candidates = model._short(unit, iter(()), places)
        assert len(places) == candidates and [(candidates, model.packed(pieces))] == [*model.plain([unit])]
        for k in (1, 2, 3):
            for numbers in subsets(range(candidates), k):
                assert model.after(unit, bytes(places), numbers[0], iter(numbers[1:])) == model.without(unit, iter(numbers))


def test_kept_words_serve_later_tasks_within_their_room():
    from tracegauge.llm.merge_dropout import worker_encoder

    first = worker_encoder(PIECES, 0.3, 7, 50)
    assert worker_encoder(PIECES, 0.3, 7, 50) is first and worker_encoder(PIECES, 0.3, 8, 50) is not first
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    got = [*first.packed_rows(rows)]
    assert got == [Encoder(PIECES, 0.3, 7, 1000).packed(t, i) for i, t in rows]
    assert all(0 < len(kept) <= 50 for kept in (first.known, first.varied, first.traces))


def test_short_words_are_merged_side_by_side(monkeypatch):
    from tracegauge.llm import merge_dropout

    rnd, model = random.Random(4), Model(PIECES)
    words = ["outstanding", "the", "aaaaaaaaaa", "a", "Straße", "x,y;z", "1234567", "résumé", "banana", "don't", "the-the-the"]
    rows = [(i, "  ".join(rnd.choice(words) + rnd.choice(["", "s", " "]) for _ in range(60))) for i in range(20)]
    monkeypatch.setattr(merge_dropout, "SIDE_BY_SIDE", 7)
    for dropout in (0.0, 0.1, 0.7):
        want = []
        for i, text in rows:
            units = model.units.findall(" " + text)
            keys = Skips(2**60).keys(xxhash.xxh3_64_intdigest(f"3 {i}"), len(units)).tolist()
            want.append(b"".join(model.packed(model.segment(u, int(dropout * 2**64), k)) for u, k in zip(units, keys)))
        with monkeypatch.context() as here:
            one_by_one = []
            here.setattr(Model, "_merged", lambda self, symbols, *rest: one_by_one.append(symbols))
            assert [*Encoder(PIECES, dropout, 3, 1000).packed_rows(rows)] == want and not one_by_one


def test_share_of_skips():
    for rate in (0.0001, 0.1, 0.9):
        skips = Skips(int(rate * 2**64))
        keys = skips.keys(3, 2000)
        numbers = [[*skips.of(k, "x" * 100)] for k in keys.tolist()]
        assert all(a == sorted(set(a)) and all(0 <= x < 300 for x in a) for a in numbers)
        n, want = sum(map(len, numbers)), rate * 300 * 2000
        assert abs(n - want) < 5 * (want * (1 - rate)) ** 0.5
        assert all(g == (a[0] if a and a[0] < 64 else 64) for g, a in zip(skips.first(keys).tolist(), numbers))


def test_long_units_decode():
    model = Model(PIECES)
    for unit in ("understanding" * 300, "w" * 41, "é日x" * 30):
        for rate in (0, 2**62, 2**63):
            assert "".join(model.segment(unit, rate, 5)) == unit


def test_empty_table(docs_of):
    docs = docs_of(["x"]).limit(0)
    assert token_counts(docs, BPE).count() == 0 and pack(pieces(docs, BPE)).count() == 0 and round_trip(docs, PIECES).count() == 0


def test_whole_texts_equal_the_library():
    from tracegauge.llm.pretokens import WholeTexts, tokenizer

    whole, library, rnd = WholeTexts(BPE), tokenizer(BPE), random.Random(9)
    assert whole.by_rank is not None
    parts = ["the", " of", "  ", "\n", "\t", "\r\n", "don't", "I'LL", "é", "Ünder", "<|endoftext|>", "<|endof", "x_y", "1234567", "!?", "…", "привет", "\u00a0", "\u1680", "ƺ", "ǆ", "\x1c", "🙂", "aaaaaaaaaaaaaaaa"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randrange(12))) for _ in range(3000)] + ["ab" * 50_000]
    for text in texts:
        assert list(memoryview(whole.ids(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_summaries_keep_what_is_common():
    from collections import Counter

    from tracegauge.llm.token_counts import summary

    rnd, counts, true = random.Random(1), Counter(), Counter()
    for _ in range(200):
        words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(500)]
        counts.update(words)
        true.update(words)
        counts = summary(counts, 100)
    assert len(counts) <= 100 and {w for w, _ in true.most_common(10)} <= {w for w, _ in counts.most_common(20)}
    assert all(n <= true[w] for w, n in counts.items())
