"""Host rules against plain Python."""

import re

from tracegauge.llm.quality_rules import host_verdicts, keep_documents, quality_rules, with_measures


def measures(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None,
    "",
    " \n\t ",
    "a b c a b c a",
    "x y z",
    "a a a a a",
    "line one\nline one\n\nline one \nother",
    "é ü # $ <b> 日本 𝒳",
    " lead and trail \x0b\x0c\r end ",
    " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i % 20}" for i in range(60)),
]


def test_measures(docs_of):
    got = {r.doc_id: r for r in quality_rules(docs_of(TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r, m = got[i], measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert r.kept == (not r.base_failed)  # one host is no worse than all hosts


def test_bad_host_goes_and_small_host_is_drawn_to_the_rest(docs_of):
    good = [" ".join(f"g{i}w{j}" for j in range(60)) for i in range(40)]
    texts = ["short"] * 49 + good[:1] + good[1:39] + ["short"] + good[39:]
    sources = ["bad"] * 50 + ["good"] * 38 + ["tiny"] + [None]
    rows = {r.doc_id: r for r in quality_rules(docs_of(texts, sources)).collect()}
    assert rows[49].host_rejected and not rows[49].base_failed and not rows[49].kept
    assert all(rows[i].kept for i in range(50, 88))
    assert not rows[88].host_rejected or rows[88].base_failed
    assert rows[89].kept
    verdicts = {r.host: r for r in host_verdicts(with_measures(docs_of(texts, sources).select("source", "text"), "text"), "source").collect()}
    assert verdicts["good"].rate_base < verdicts["tiny"].rate_base <= 1
    assert verdicts["bad"].rate_base < 49 / 50 + 1e-9


def test_stage_keeps_columns_and_rows(docs_of):
    from pyspark.sql import functions as F

    docs = docs_of(TEXTS).withColumns({"host": F.lit("x"), "n_words": F.lit(1), "_words": F.lit(2)})
    kept = keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [9, 10]


def test_empty_table(docs_of):
    docs = docs_of(["x"]).limit(0)
    assert quality_rules(docs).count() == 0 and keep_documents(docs).count() == 0
