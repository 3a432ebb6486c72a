"""Operator 3: exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are sparse integer rows (dimension, weight; zero weights are not stored). Both are hashed into groups
whose number follows the row count, so that a group is about ``GROUP_ROWS`` rows however large the table; each pair of a query
group and a candidate group is one task's work. There, postings lists by dimension are walked one term at a time and scattered
into a dense block of scores; a partition selects each query's best k, and a window merges the partitions.

Defined results: a vector that is null, or holds a null or a non-finite component, takes no part (an empty one does, with
score 0); vectors of different lengths count missing components as 0; ties go to the smaller vec_id; rows that share a vec_id are
separate candidates, but none of them is a candidate for a query with that id; fewer candidates than k give all; no rows give no
rows. Scores are exact while they fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table

GROUP_ROWS = 16_384
QUERY_BLOCK = 64
CANDIDATE_BLOCK = 4096


def quantized(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows vec_id, weights array<long>: floor(scale * x) of each component, for vectors that take part."""
    x = vectors[vector].cast("array<double>")
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(x.isNotNull() & finite).select(vectors[vec_id].cast("long").alias("vec_id"), whole.alias("weights")).where("vec_id IS NOT NULL")


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and weight of each non-zero weight of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    weights = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    dim = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(weights)
    return row[some], dim[some], weights[some]


def _postings(row: np.ndarray, dim: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(dim, kind="stable")
    row, dim, weight = row[order], dim[order], weight[order]
    terms, at = np.unique(dim, return_index=True)
    ends = [*at[1:].tolist(), len(dim)]
    return {int(t): (row[a:b], weight[a:b]) for t, a, b in zip(terms, at.tolist(), ends, strict=True)}


def search_block(q_ids: np.ndarray, q: tuple, c_ids: np.ndarray, c: tuple, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each query's best k of these candidates: query ids, candidate ids, scores."""
    q_row, q_dim, q_weight = q
    c_row, c_dim, c_weight = c
    q_cuts = np.searchsorted(q_row, np.arange(0, len(q_ids) + QUERY_BLOCK, QUERY_BLOCK))
    for c0 in range(0, len(c_ids), CANDIDATE_BLOCK):
        a, b = np.searchsorted(c_row, (c0, c0 + CANDIDATE_BLOCK))
        postings = _postings(c_row[a:b] - c0, c_dim[a:b], c_weight[a:b])
        ids = c_ids[c0 : c0 + CANDIDATE_BLOCK]
        for q0 in range(0, len(q_ids), QUERY_BLOCK):
            x, y = q_cuts[q0 // QUERY_BLOCK], q_cuts[q0 // QUERY_BLOCK + 1]
            block = q_ids[q0 : q0 + QUERY_BLOCK]
            scores = np.zeros((len(block), len(ids)), np.int64)
            for term, (rows, weights) in _postings(q_row[x:y] - q0, q_dim[x:y], q_weight[x:y]).items():
                if term in postings:
                    at, w = postings[term]
                    if len(at) == len(ids) and len(rows) == len(block):
                        scores += weights[:, None] * w
                    else:
                        scores[np.ix_(rows, at)] += weights[:, None] * w
            for r, query in enumerate(block):
                other = np.flatnonzero(ids != query)
                s = scores[r, other]
                if len(s) > k:  # all that reach the k-th score, so that ties can be put in order
                    best = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    other, s = other[best], s[best]
                order = np.lexsort((ids[other], -s))[:k]
                yield np.full(len(order), query), ids[other[order]], s[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates. Both inputs as ``quantized`` returns them."""
    spark = queries.sparkSession
    small_batches(spark)
    q_groups = max(1, -(-queries.count() // GROUP_ROWS))
    c_groups = max(1, -(-candidates.count() // GROUP_ROWS))

    def cells(rows: DataFrame, own: int, other: int, own_name: str, other_name: str) -> DataFrame:
        return rows.withColumn(own_name, F.pmod(F.xxhash64("vec_id"), F.lit(own)).cast("int")).withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        ids = [x.column("vec_id").to_numpy() for x in (q, c)]
        found = list(search_block(ids[0], _rows(q.column("weights")), ids[1], _rows(c.column("weights")), k)) if len(ids[0]) and len(ids[1]) else []
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    left = cells(queries, q_groups, c_groups, "q", "c").groupBy("q", "c")
    right = cells(candidates, c_groups, q_groups, "c", "q").groupBy("q", "c")
    partial = left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every vector whose id is divisible by 50."""
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


OP3_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] w
           FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
