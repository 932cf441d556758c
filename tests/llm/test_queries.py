"""Registered queries: SQL where it can express them, and the pipeline stage by stage."""

import pytest
from oracle_check import connect, difference

import corpus_pipeline
from tracegauge.llm.common import stored
from tracegauge.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) is None


def test_pipeline_stages_agree_with_their_operators(spark, sf_dir):
    from tracegauge.llm.ngram_join import similar_documents
    from tracegauge.llm.pii import pseudonyms
    from tracegauge.llm.quality_rules import quality_rules
    from tracegauge.llm.substring_dedup import dedup_words

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir), "test-stage")
        if name != "packing":
            assert out.columns == columns
            texts = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
        if name == "quality_rules":
            assert set(texts) == {r.doc_id for r in quality_rules(docs).filter("kept").select("doc_id").collect()}
        elif name == "ngram_join":
            assert set(texts) == {r.component_id for r in similar_documents(docs).select("component_id").collect()}
        elif name == "substring_dedup":
            before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            for r in dedup_words(docs).collect():
                assert texts[r.doc_id] == (before[r.doc_id] if r.kept_text is None else r.kept_text)
        elif name == "pii":
            assert texts == {r.doc_id: r.text for r in pseudonyms(docs, corpus_pipeline.PSEUDONYM_KEY).select("doc_id", "text").collect()}
        else:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(texts)
        docs = out
