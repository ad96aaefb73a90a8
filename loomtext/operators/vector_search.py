"""C6 as a search: the k largest dot products of every query row, exactly.

The query set is a table.  Vectors are dealt into buckets of a bounded size and queries
into chunks; each (bucket, chunk) is one matrix product in Arrow, taken block by block, and
a block passes each query's k-th score on as the bound that the next one must beat.  So a
bucket hands out k rows a query, and nothing is collected.  The work is queries times
vectors, as an exact search has to be; the shuffle is vectors x chunks + queries x buckets.

Defined cases: null vectors, and pairs of different lengths, have no score; a null score
(an element is null) ranks nowhere; equal scores go by id; an empty side gives no rows;
equal rows of the query table are one query, equal rows of
vectors are each found; scores are rounded to ``DIGITS`` before ranking.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

BUCKET_ROWS, CHUNK_ROWS, BLOCK_ROWS = 50_000, 4_096, 4_096
DIGITS = 9


def _matrices(table: pa.Table):
    """(ids, matrix) per vector length."""
    vectors = table.column("v").combine_chunks()
    ids = table.column("id").to_numpy()
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield int(n), ids[at], flat.reshape(len(at), n)


def _search(k: int):
    def best(queries, ids, matrix):
        """Running top k of each query: (scores, ids), worst last."""
        score = np.full((len(queries), 0), 0.0)
        found = np.zeros((len(queries), 0), np.int64)
        for start in range(0, len(ids), BLOCK_ROWS):
            block = np.round(queries @ matrix[start:start + BLOCK_ROWS].T, DIGITS)
            block[np.isnan(block)] = -np.inf
            here = ids[start:start + BLOCK_ROWS]
            if score.shape[1] == k:
                # only columns that reach some query's k-th score so far
                reach = (block >= score[:, -1:]).any(axis=0)
                block, here = block[:, reach], here[reach]
            both = np.concatenate([score, block], axis=1)
            names = np.concatenate([found, np.broadcast_to(here, block.shape)], axis=1)
            order = np.lexsort((names, -both), axis=1)[:, :k]
            score, found = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        return score, found

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vectors = {n: (i, m) for n, i, m in _matrices(left)}
        out = []
        for n, names, matrix in _matrices(right):
            if n in vectors:
                score, found = best(matrix, *vectors[n])
                real = np.isfinite(score)
                out.append((np.repeat(names, score.shape[1])[real.ravel()], found[real], score[real]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})
    return run


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
           bucket_rows: int = BUCKET_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query, id, score, rank): each query's k best vectors.  Ids are integers."""
    ship_package(vectors.sparkSession)
    def rows(df):
        return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    left, right = rows(vectors), rows(queries).distinct()
    buckets = max(1, math.ceil(left.count() / bucket_rows))
    chunks = max(1, math.ceil(right.count() / chunk_rows))
    left = left.select("id", "v", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).alias("b"),
                       F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"))
    right = right.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("b"),
                         F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("c"))
    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(
        _search(k), "query long, id long, score double")
    # at most k rows a bucket for each query
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
