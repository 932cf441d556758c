"""Exact Jaccard join of documents on word shingles by prefix filters under several token orders.

Two sets of n and m tokens with a Jaccard similarity of t or more share t * max(n, m) tokens at least. So
under any order of the tokens that all sets agree on, the first n - ceil(t * n) + 1 tokens of both (their
prefixes) share one, and each further token of prefix adds one more that they must share. A pair
has to pass this filter under three orders before it is verified:

1. by hash: a set goes on if its prefix, lengthened by a tenth, shares enough tokens with other sets;
2. by frequency among the sets that went on, rarest first: a set needs ceil(t * n) tokens that others have,
   and candidates are those that meet in the prefix of its rarest tokens, early enough for the rest to
   hold what is needed, and whose token parities do not show too many differences;
3. by another hash: candidates must also share a token of these prefixes.

Equal sets are one class before the join. Components need no pair that they already imply: a class is first
verified against one leader of each of its prefix tokens, in two rounds with different leaders, and only
classes of a token that are still apart are then compared with all others of it. No link is lost: every
candidate pair is either verified or inside one component.

Defined results: a null or empty text has no shingles, is its own component and links with nothing. A text with
fewer words than a shingle is one shingle. Repeated rows are equal sets and one component. A null id never
names a component unless all its documents have null ids. An empty table gives an empty result. Other
columns are ignored (``similar_documents``) or kept (``one_of_each``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.llm.common import stored, text_key
from tracegauge.llm.components import components
from tracegauge.llm.sent_texts import SENT, send_once, unpacked
from tracegauge.llm.words import mix, pieces, run_hashes, word_hashes, word_spans

#: Bits of a token that the first filter looks at; tokens that agree in them can only add candidates.
SHORT_BITS = 48
#: Percent of the set by which the first prefix is longer than it must be.
EXTRA = 10
#: Rows that a worker turns into sets or rows of the index at once.
AT_ONCE = 512
#: Rounds of leaders.
ROUNDS = 2
#: Numbers of 64 parity bits that stand for the shared tokens of a set.
SIGNS = 8
INDEX = ["token", "cid", "n", "place", "alone", *[f"s{i}" for i in range(SIGNS)]]


def _sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of each row of a piece; A-Z count as a-z."""
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends, fold=True)
    runs = run_hashes(words, size)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(run_hashes(words[a:b], int(b - a)) + np.uint64(b - a) if b > a else words[:0])
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``AT_ONCE`` at a time. A row's sets, or its rows of the index, take many times its own bytes in a
    worker and in the batch that goes back to the executor."""
    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(first, AT_ONCE)


def _need(n: Column, percent: int) -> Column:
    """The fewest tokens that a set of ``n`` shares with a similar one."""
    return F.ceil(n * percent / 100).cast("long")


def _sign(size: int, percent: int, with_prefix: bool):
    """doc_id, k1, k2, text -> doc_id, k1, k2, f1, f2, n and the first prefix."""
    other = np.uint64(0xA0761D6478BD642F)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            f1, f2, ns, prefixes = [], [], [], []
            for _, data, at in pieces(batch.column(3)):
                for tokens in _sets(data, at, size):
                    n = len(tokens)
                    ns.append(n)
                    f1.append(int(mix(tokens).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                    f2.append(int(mix(tokens ^ other).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                    if with_prefix:
                        need = -(-n * percent // 100)
                        prefixes.append((tokens[: n - need + 1 + n * EXTRA // 100] >> np.uint64(64 - SHORT_BITS)).view(np.int64))
            new = [pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(ns, pa.int64())]
            names = [*batch.schema.names[:3], "f1", "f2", "n"]
            if with_prefix:
                new.append(pa.array(prefixes, pa.list_(pa.int64())))
                names.append("prefix")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names)

    return run


def _whole_sets(size: int, percent: int):
    """cid, packed -> cid, n, tokens and the prefix under the third order."""
    other = np.uint64(0xE7037ED1A0B428DB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ns, sets, thirds = [], [], []
            for _, data, at in pieces(unpacked(batch.column(1))):
                for tokens in _sets(data, at, size):
                    n = len(tokens)
                    ns.append(n)
                    sets.append(tokens.view(np.int64))
                    thirds.append(np.sort(mix(tokens ^ other))[: n - -(-n * percent // 100) + 1].view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(sets, kind), pa.array(thirds, kind)], ["cid", "n", "tokens", "third"])

    return run


def _shared_tokens(sets: DataFrame, column: str) -> DataFrame:
    """cid, n and ``shared``: the tokens of ``column`` that other rows have too, as (df, token), rarest first."""
    rows = sets.select("cid", "n", F.explode(column).alias("token"))
    # Counted where the rows of a token meet, so they are shuffled once; a join with a table of counts would shuffle them again. The
    # rows of a hot token are three numbers each, and Spark spills them.
    counted = rows.withColumn("df", F.count("*").over(Window.partitionBy("token"))).filter("df > 1")
    return counted.groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar, of those that pass the third order."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), F.col("third").alias("pa"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.col("third").alias("pb"))
    both = pairs.join(left, "a").join(right, "b").filter(F.arrays_overlap("pa", "pb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return both.filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _index(percent: int):
    """cid, n, shared (tokens that others have, rarest first) -> one row for each token of the prefix under
    the second order, with its place there, the number of tokens that no other set has (``alone``) and
    the parities of the shared tokens, dealt to 64 * SIGNS bits by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            flat, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            bit = (mix(flat) >> np.uint64(40)).astype(np.int64) % (64 * SIGNS)
            kept, rows, places, signs = [], [], [], np.zeros((len(cids), SIGNS), np.int64)
            for i, (n, x, y) in enumerate(zip(sizes, ends[:-1], ends[1:])):
                k = int(y - x) - -(-int(n) * percent // 100) + 1
                kept.append(flat[x : x + k])
                rows.append(np.full(k, i))
                places.append(np.arange(k) + n - (y - x))
                odd = (np.bincount(bit[x:y], minlength=64 * SIGNS) & 1).astype(np.uint8)
                signs[i] = np.packbits(odd).view(np.int64)
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            columns = [np.concatenate(kept).view(np.int64) if kept else row, cids[row], sizes[row], np.concatenate(places) if places else row, (sizes - np.diff(ends))[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, *signs[row].T]], INDEX)

    return run


def _close(percent: int) -> Column:
    """Whether two rows of a token can belong to similar sets: by their sizes, by what is left behind the
    token in both, and by the tokens that surely stand in one set only."""
    size = F.col("n_a") + F.col("n_b")
    common = F.ceil(size * percent / (100 + percent))
    fit = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    behind = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= common
    apart = F.col("alone_a") + F.col("alone_b")
    for i in range(SIGNS):
        apart = apart + F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b")))
    return fit & behind & (apart <= size - 2 * common)


def _linked(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cid, component of classes that have a link, from the candidates' index (rows of INDEX)."""
    spark, tested, labels = index.sparkSession, None, None
    own = [*INDEX[1:], "component"]
    side = lambda rows, s: rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in own])
    differ = F.col("component_a") != F.col("component_b")
    for turn in range(ROUNDS + 1):
        here = index.withColumn("component", F.col("cid")) if labels is None else index.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        if labels is not None:
            apart = here.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
            here = stored(here.join(apart, "token"), "apart")
        # A text that others were copied from has the fewest tokens of its own, so it leads first.
        leader = F.min(F.struct("alone", F.xxhash64("cid", F.lit(turn)).alias("h"), *[c for c in own if c != "alone"]))
        lead = lambda rows: rows.groupBy("token").agg(leader.alias("l")).select("token", "l.*").drop("h")
        leaders = stored(lead(here), "leaders")
        if 0 < turn < ROUNDS:  # the first leader has been tried; one outside of its component is next
            mains = leaders.select("token", F.col("component").alias("main"))
            leaders = stored(lead(here.join(mains, "token").filter("component <> main").drop("main")), "leaders")
        if turn < ROUNDS:
            pairs = side(here, "a").join(side(leaders, "b"), "token").filter(differ & _close(percent))
        else:  # all that are still apart: those outside the leader's component with the rest of the token
            mains = leaders.select("token", F.col("component").alias("main"))
            outside = side(here.join(mains, "token").filter("component <> main").drop("main"), "a")
            rest = side(here, "b").join(mains, "token")
            once = (F.col("component_b") == F.col("main")) | (F.col("cid_a") < F.col("cid_b"))
            pairs = stored(outside, "outside").join(stored(rest, "rest"), "token").filter(differ & once & _close(percent))
        pairs = pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            if turn < ROUNDS:
                continue
            break
        tested = pairs if tested is None else tested.union(pairs)
        labels = _merged(labels, stored(_verified(pairs, sets, percent), "links"))
    return spark.createDataFrame([], "cid long, component long") if labels is None else labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """cid, component after more links. Those inside a component say nothing new, and those between two
    components count once."""
    ends = links.select(F.col("a").alias("cid")).union(links.select("b")).distinct()
    if labels is None:
        nodes = ends.withColumn("component", F.col("cid"))
    else:
        nodes = labels.union(ends.join(labels, "cid", "left_anti").withColumn("component", F.col("cid")))
    nodes = stored(nodes, "nodes")
    for c in "ab":
        links = links.join(nodes.select(F.col("cid").alias(c), F.col("component").alias(f"l{c}")), c)
    between = links.filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return stored(nodes.join(joined, "component", "left").select("cid", F.coalesce("whole", "component").alias("component")), "components")


def _classes_and_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """f1, f2, component (of set classes, as a class number) from doc_id, k1, k2, text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.mapInArrow(_sign(size, percent, True), f"doc_id {id_type}, k1 long, k2 long, f1 long, f2 long, n long, prefix array<long>").filter("n > 0")
    classes = signed.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("k"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "sets")

    near = _shared_tokens(classes, "prefix").filter(F.size("shared") > F.floor(_need(F.col("n"), percent) * EXTRA / 100))
    wanted = stored(near.select("cid").join(classes.select("cid", "k.k1", "k.k2"), "cid"), "first-filter")
    texts = docs.select("k1", "k2", "text").mapInArrow(send_once, SENT).join(wanted, ["k1", "k2"])
    one = texts.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).filter("nth = 1").select("cid", "packed")
    sets = stored(one.mapInArrow(_whole_sets(size, percent), "cid long, n long, tokens array<long>, third array<long>"), "whole-sets")

    need, have = _need(F.col("n"), percent), F.size("shared")
    rare = _shared_tokens(sets, "tokens").filter(have >= need).select("cid", "n", F.transform("shared", lambda x: x["token"]).alias("shared"))
    index = rare.mapInArrow(_index(percent), ", ".join(f"{c} long" for c in INDEX))
    linked = _linked(stored(index, "index"), sets, percent)
    own = classes.select("f1", "f2", "cid", "least").join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = own.groupBy("component").agg(F.min("least").alias("component_id"))
    return stored(own.select("f1", "f2", "component").join(names, "component"), "set-components")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _with_component(rows: DataFrame, size: int, percent: int) -> DataFrame:
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = _classes_and_components(rows, size, percent)
    signed = rows.mapInArrow(_sign(size, percent, False), f"doc_id {id_type}, k1 long, k2 long, f1 long, f2 long, n long")
    return signed.join(found, ["f1", "f2"], "left")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    rows = _with_component(_rows(docs, doc_id, text), size, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, of equal ids the smallest text key, of equal
    rows any one. Rows without shingles all stay."""
    rows = _with_component(_rows(docs, doc_id, text), size, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    stay = stored(rows.filter("n > 0").groupBy("component").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("_id"), F.col("o.k1").alias("_k1"), F.col("o.k2").alias("_k2")), "kept")
    k1, k2 = text_key(F.col(f"`{text}`"))
    blank = ~F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").alias("_id0"), k1.alias("_k1"), k2.alias("_k2"), blank.alias("_blank"))
    kept = packed.filter("not _blank").join(stay, ["_k1", "_k2"]).filter(F.col("_id0").eqNullSafe(F.col("_id")))
    kept = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1"))).filter("_nth = 1")
    return kept.select("_row.*").union(packed.filter("_blank").select("_row.*"))
