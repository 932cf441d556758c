"""Batch top-k text search with BM25 over a corpus.

Exhaustive scoring forms every (query, document) pair that shares any word, and common words make
that nearly all pairs. Here each query keeps a lower bound of its k-th best score; words whose
largest possible contributions together stay below that bound cannot put a document into the top k
alone, so documents are fetched through the other words only, and the common words are looked up
for those documents. The result is the same as that of exhaustive scoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.functions.exprs import round_half
from tracegauge.functions.text import words
from tracegauge.operators.scratch import materialize, measured_side

K1 = 1.2
B = 0.75
# Scores are ranked after rounding to 6 digits; pruning keeps a wider margin than that.
SCORE_DIGITS = 6
MARGIN = 1e-5
# Documents scored in full per query to find the bound, as a multiple of k.
SEEDS = 4
NO_WORD = ""
# Words are left to the lookup while they can add up to this share of the bound. A larger share fetches
# fewer documents, a smaller one drops more of them before the lookup. Any share below 1 is exact.
LOOKUP_SHARE = 0.9


def doc_words(corpus: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return corpus.select(F.col(doc).alias("doc_id"), words(F.coalesce(text, F.lit(""))).alias("words")).select(
        "doc_id", "words", F.size("words").cast("bigint").alias("n_words")
    )


def build_postings(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, n_words); with a vocabulary only its terms are kept, before the shuffle."""
    # An inner explode makes Spark split every text a second time for a filter on empty lists.
    tokens = docs.select("doc_id", "n_words", F.explode_outer("words").alias("term")).filter(F.col("term").isNotNull())
    if vocabulary is not None:
        tokens = tokens.join(vocabulary, "term")
    return tokens.groupBy("doc_id", "n_words", "term").agg(F.count(F.lit(1)).alias("tf"))


def with_lengths(docs: DataFrame) -> DataFrame:
    """Add an empty word, which no text contains, to every document. Its posting carries the length of
    the document, so postings and corpus totals come from one pass over the texts."""
    return docs.withColumn("words", F.concat("words", F.array(F.lit(NO_WORD))))


def postings_and_size(docs: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of a vocabulary, and the totals of the whole corpus."""
    wanted = vocabulary.unionByName(vocabulary.sparkSession.range(1).select(F.lit(NO_WORD).alias("term")))
    rows = materialize(build_postings(with_lengths(docs), measured_side(wanted)), "postings")
    return rows.filter(F.col("term") != NO_WORD), corpus_size(rows.filter(F.col("term") == NO_WORD))


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_words").alias("avg_words"))


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    return queries.select(F.col(query).alias("query_id"), F.explode_outer(F.array_distinct(words(F.col(text)))).alias("term")).filter(F.col("term").isNotNull())


def _kth_largest(df: DataFrame, keys: list[str], value: str, k: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == k).select(*keys, F.col(value).alias(name))


def weigh(postings: DataFrame, size: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, w): what a word adds to the score of a document; (term, bound): the most it adds
    to any."""
    n, avg = size.select("n_docs").scalar(), size.select("avg_words").scalar()
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n_words") / avg)
    impacts = postings.select("doc_id", "term", (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("_impact"))
    terms = impacts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.max("_impact").alias("_top"))
    terms = terms.select("term", "_top", F.log(1 + (n - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("_idf"))
    weighted = impacts.join(terms.select("term", "_idf"), "term").select("doc_id", "term", (F.col("_idf") * F.col("_impact")).alias("w"))
    return weighted, terms.select("term", (F.col("_idf") * F.col("_top")).alias("bound"))


def score_floor(weighted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): a lower bound of each query's k-th best score. The best documents of every
    single word are added up, the most promising of them are scored in full, and the k-th best of
    those is the bound. Queries with fewer than k such documents get none."""
    per_term = Window.partitionBy("term").orderBy(F.col("w").desc(), F.col("doc_id").asc())
    best = weighted.withColumn("_rn", F.row_number().over(per_term)).filter(F.col("_rn") <= k).select("doc_id", "term", "w")
    seeds = asked.join(best, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("_seed"))
    per_query = Window.partitionBy("query_id").orderBy(F.col("_seed").desc(), F.col("doc_id").asc())
    tried = seeds.withColumn("_rn", F.row_number().over(per_query)).filter(F.col("_rn") <= SEEDS * k).select("query_id", "doc_id")
    full = (
        tried.join(asked.select("query_id", "term"), "query_id")
        .join(weighted, ["doc_id", "term"])
        .groupBy("query_id", "doc_id")
        .agg(F.sum("w").alias("_full"))
    )
    return _kth_largest(full, ["query_id"], "_full", k, "floor")


def plan_terms(weighted: DataFrame, bounds: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, term, lookup, rest, floor): which words of a query fetch documents and which are only
    looked up. ``rest`` is what all looked-up words can add together."""
    asked = wanted.join(bounds, "term").select("query_id", "term", "bound")
    floor = score_floor(weighted, asked, k)
    upward = Window.partitionBy("query_id").orderBy(F.col("bound").asc(), F.col("term").asc()).rowsBetween(Window.unboundedPreceding, 0)
    plan = asked.withColumn("_weak", F.sum("bound").over(upward)).join(floor, "query_id", "left")
    plan = plan.withColumn("lookup", F.coalesce(F.col("_weak") + MARGIN < LOOKUP_SHARE * F.col("floor"), F.lit(False)))
    rest = F.coalesce(F.max(F.when(F.col("lookup"), F.col("_weak"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    return plan.select("query_id", "term", "lookup", rest.alias("rest"), "floor")


def rank_documents(postings: DataFrame, size: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query, ties by document id."""
    weighted, bounds = weigh(postings, size)
    weighted = materialize(weighted, "weights")
    plan = materialize(plan_terms(weighted, bounds, wanted, k), "search-plan")

    found = (
        plan.filter(~F.col("lookup"))
        .join(weighted, "term")
        .groupBy("query_id", "doc_id")
        .agg(F.sum("w").alias("_strong"), F.max("rest").alias("rest"), F.max("floor").alias("floor"))
    )
    # A document that stays below the bound even with every looked-up word is out.
    alive = found.filter(F.col("floor").isNull() | (F.col("_strong") + F.col("rest") + MARGIN >= F.col("floor")))
    looked_up = (
        alive.select("query_id", "doc_id", "_strong")
        .join(plan.filter("lookup").select("query_id", "term"), "query_id", "left")
        .join(weighted, ["doc_id", "term"], "left")
    )
    score = F.max("_strong") + F.coalesce(F.sum("w"), F.lit(0.0))
    total = looked_up.groupBy("query_id", "doc_id").agg(round_half(score, SCORE_DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return total.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 10,
    doc: str = "doc_id",
    text: str = "text",
    attributes: tuple[str, ...] = (),
    query: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """Many queries against one text column. Filter the corpus before the call to search a part of
    it; ``attributes`` are corpus columns to return with each hit."""
    docs = doc_words(corpus, doc, text)
    wanted = query_terms(queries, query, query_text)
    postings, size = postings_and_size(docs, wanted.select("term").distinct())
    hits = rank_documents(postings, size, wanted, k)
    if attributes:
        hits = hits.join(corpus.select(F.col(doc).alias("doc_id"), *attributes), "doc_id")
    return hits.select("query_id", "rank", "doc_id", "score", *attributes)


def group_hits(hits: DataFrame, by: str, examples: int = 3) -> DataFrame:
    """Hits with the same text as one row: count, best rank, first id and a few example ids. A query
    has at most k hits, so the collected sets are small."""
    return hits.groupBy("query_id", by).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.min("rank").alias("best_rank"),
        F.min("doc_id").alias("first_id"),
        F.concat_ws(",", F.transform(F.slice(F.sort_array(F.collect_set("doc_id")), 1, examples), lambda d: d.cast("string"))).alias("example_ids"),
    )
