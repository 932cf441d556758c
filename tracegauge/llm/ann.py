"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector is scaled to length one, padded and turned by a seeded random rotation; the code keeps the
sign of every coordinate, packed into bits, and one correction scalar, the inner product of the turned
vector with its own code. Code times query, divided by the scalar, estimates the cosine without bias, and
the scalar bounds the error up to a chosen number of standard deviations. A query's threshold is the
k-th best lower bound; every vector whose upper bound reaches it is reranked by the exact cosine.

Queries meet all vectors in cells: vectors are dealt to shards and queries to groups, both of bounded
size, and one task holds one shard and one group. Each cell gives k rows for each of its queries.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part.
Vectors of different dimension are never compared. Rows are told apart by an own number, so a
repeated row is a neighbour of its copy. Ties go to the smaller id, a null id last. Fewer candidates than
``k`` give fewer rows, an empty table none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.llm.common import stored


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """The first ``dim`` rows of a random orthogonal matrix of ``bits`` columns."""
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return turn[:dim].astype(np.float32)


def code_bits(dim: int, bits: int) -> int:
    return max(bits, -(-dim // 64) * 64)


def encode(vectors: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction scalars of the rows of ``vectors``."""
    bits = code_bits(vectors.shape[1], bits)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit.astype(np.float32) @ rotation(vectors.shape[1], bits, seed)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(bits)


def reranked(codes, scalars, vectors, ids, rows, query_vectors, query_rows, k, bits, seed, deviations):
    """(query, candidate, exact cosine) of the best ``k`` of each query in one cell."""
    bits = code_bits(vectors.shape[1], bits)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    query_unit = query_vectors / np.linalg.norm(query_vectors, axis=1, keepdims=True)
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    error = np.sqrt(np.maximum(1 - scalars**2, 0)) / scalars * (deviations / np.sqrt(bits - 1)) + 1e-5
    turned = query_unit.astype(np.float32) @ rotation(vectors.shape[1], bits, seed)
    found = []
    for first in range(0, len(turned), 128):
        estimate = turned[first : first + 128] @ signs.T / (np.sqrt(bits) * scalars)
        for q, row in enumerate(estimate, first):
            allowed = rows != query_rows[q]
            lower = (row - error)[allowed]
            if not len(lower):
                continue
            least = np.partition(lower, -k)[-k] if len(lower) > k else -np.inf
            near = np.flatnonzero((row + error >= least) & allowed)
            score = np.einsum("ij,j->i", vectors[near], query_vectors[q]) / (np.linalg.norm(vectors[near], axis=1) * np.linalg.norm(query_vectors[q]))
            best = np.lexsort((ids[near], -score))[:k]
            found += [(q, near[b], score[b]) for b in best]
    return found


def nearest(
    table: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    bits: int = 256,
    seed: int = 7,
    deviations: float = 3.0,
    shard_rows: int = 2048,
    group_queries: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found for every row where ``is_query`` holds.

    ``is_query`` is written on the column ``vec_id``; ``deviations`` sets how sure the error bounds are.
    """
    v = F.col("vector")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(whole)
    rows = rows.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()})

    def code(batches):
        for batch in batches:
            dims, flat = batch.column("dim").to_numpy(), batch.column("vector").flatten().to_numpy()
            ends = np.cumsum(dims)
            codes, scalars = [b""] * len(dims), np.zeros(len(dims))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                packed, scalar = encode(flat[(ends[own] - dim)[:, None] + np.arange(dim)], bits, seed)
                scalars[own] = scalar
                for i, p in zip(own, packed):
                    codes[i] = p.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(scalars)], [*batch.schema.names, "code", "scalar"])

    coded = stored(rows.mapInArrow(code, "vec_id long, vector array<double>, dim int, row long, code binary, scalar double"), "codes")
    # New names: columns of one table on both sides of a cogroup confuse Spark's column pruning.
    asked = coded.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.col("dim").alias("query_dim"), F.col("row").alias("query_row"))
    sizes = coded.agg(F.count("*"), F.count_if(is_query)).first()
    shards, groups = max(1, -(-sizes[0] // shard_rows)), max(1, -(-sizes[1] // group_queries))
    left = coded.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("group", F.pmod(F.xxhash64("query_row"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def cell(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if len(candidates) and len(queries):
            dim = candidates["dim"][0].as_py()
            matrix = lambda column: column.combine_chunks().flatten().to_numpy().reshape(-1, dim)
            ids = candidates["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            codes = np.frombuffer(b"".join(candidates["code"].to_pylist()), np.uint8).reshape(len(candidates), -1)
            found = reranked(codes, candidates["scalar"].to_numpy(), matrix(candidates["vector"]), ids, candidates["row"].to_numpy(), matrix(queries["query"]), queries["query_row"].to_numpy(), k, bits, seed, deviations)
        q, c, s = zip(*found) if found else ((), (), ())
        pick = lambda t, name, at: t[name].combine_chunks().take(pa.array(at, pa.int64())) if len(t) else pa.array([], pa.int64())
        return pa.table({"query_row": pick(queries, "query_row", q), "query_id": pick(queries, "query_id", q), "vec_id": pick(candidates, "vec_id", c), "score": pa.array(s, pa.float64())})

    best = left.groupBy("dim", "shard", "group").cogroup(right.groupBy("query_dim", "shard", "group")).applyInArrow(cell, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
