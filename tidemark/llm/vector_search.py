"""Exact top-k search by inner product, with segment statistics at several resolutions.

Vectors are quantised to whole numbers. A vector is cut into segments, and each segment is described
by its mean and deviation; between two vectors, the squared distance is at least the sum over the
segments of length * ((difference of means) ** 2 + (difference of deviations) ** 2), whatever the
number of segments. As |a - b| ** 2 = |a| ** 2 + |b| ** 2 - 2 a.b, a lower bound of the distance is
an upper bound of the inner product. Bounds are taken with few segments first; pairs that could
still reach the query's k-th best go on to more segments, and survivors get exact products.

The stated queries meet all vectors in blocks of at most ``BLOCK`` rows on either side; a cell of
two blocks keeps at most k rows per query, and the best of all cells are the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored, table

BLOCK = 4096
QUERY_BLOCK = 512
SEGMENTS = (4, 16)
K = 5


def usable(vector: Column) -> Column:
    """Vectors with at least one component and only finite ones."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: means and deviations of the segments, each times the root of the segment's length, so
    that a plain inner product of two rows bounds the inner product of the vectors from above."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    length = np.diff(cuts)
    sums = np.add.reduceat(x, cuts[:-1], axis=1)
    squares = np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = sums / length
    deviation = np.sqrt(np.maximum(squares / length - mean * mean, 0))
    return np.hstack((mean, deviation)) * np.sqrt(np.hstack((length, length)))


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
                  k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and exact score of every query's k best in a block, ties to smaller ids."""
    q, x = queries.astype(float), vectors.astype(float)
    norms = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :]
    slack = 1e-9 * norms + 1e-6
    m = len(ids)
    alive = query_ids[:, None] != ids[None, :]
    floor = np.full(len(q), -np.inf)
    for segments in SEGMENTS:
        a, b = statistics(q, segments), statistics(x, segments)
        distance = np.maximum(norms - 2 * (a @ b.T), 0)  # lower bound of the squared distance
        bound = np.where(alive, (norms - distance) / 2 + slack, -np.inf)
        # exact products of the most promising few set what the others have to reach
        few = min(2 * k, m)
        top = np.argpartition(-bound, few - 1, axis=1)[:, :few]
        exact = np.einsum("qd,qcd->qc", queries, vectors[top]).astype(float)
        exact[~np.take_along_axis(alive, top, axis=1)] = -np.inf
        if few >= k:
            floor = np.maximum(floor, -np.sort(-exact, axis=1)[:, k - 1])
        alive &= bound >= floor[:, None]
    rows, cols = np.nonzero(alive)
    score = np.empty(len(rows), np.int64)
    for s in range(0, len(rows), 1 << 18):
        e = s + (1 << 18)
        score[s:e] = np.einsum("nd,nd->n", queries[rows[s:e]], vectors[cols[s:e]])
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    first = np.searchsorted(rows, rows)
    best = np.arange(len(rows)) - first < k
    return query_ids[rows[best]], ids[cols[best]], score[best]


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and quantised vectors."""
    flat = rows["embedding"].combine_chunks().flatten().to_numpy().astype(float)
    return rows["vec_id"].to_numpy(), np.floor(256 * flat.reshape(rows.num_rows, -1)).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: every query's k highest scores, ties to smaller ids.

    ``vectors`` has vec_id and embedding. Rows without vec_id, and vectors that are null, empty or
    hold null or non-finite components, take no part. Every row is a candidate, also where rows share a
    vec_id, but for those with the query's own id. Vectors of different length are not compared. Components stay exact as
    long as scores fit a long. An empty table gives an empty table.
    """
    rows = (vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                    F.coalesce(is_query, F.lit(False)).alias("_query"))
            .withColumn("dim", F.size("embedding")))
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("_query")).first()
    blocks, query_blocks = max(1, -(-total // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (rows.filter("_query").withColumn("qb", block(query_blocks)).withColumn("cb", every(blocks))
            .select("dim", "qb", "cb", "vec_id", "embedding"))
    right = (rows.withColumn("cb", block(blocks)).withColumn("qb", every(query_blocks))
             .select("dim", "qb", "cb", "vec_id", "embedding"))

    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        found = none, none, none
        if queries.num_rows and candidates.num_rows:
            found = best_of_block(*_matrix(queries), *_matrix(candidates), k)
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    key = ["dim", "qb", "cb"]
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vectors")
    return top_k(vectors, F.col("vec_id") % 50 == 0)
