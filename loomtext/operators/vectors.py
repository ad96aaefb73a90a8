"""Vector operators re-aimed from the model's lookup / scoring.

No cross joins: query vectors (a bounded, size-checked set) travel as one
literal array column, scores are computed per row with higher-order
functions, and top-k runs in two phases over salted buckets so no group
holds more than a bounded number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Largest query set embedded as a literal per pass (queries × dims values).
MAX_LITERAL_VALUES = 1_000_000
# Rows per salted bucket in the first top-k phase.
BUCKET_ROWS = 50_000
# Dimensions up to which a group's sums are the columns of one row.
WIDE = 512


def rms_norm(df: DataFrame, vec_col: str = "embedding", eps: float = 1e-5,
             out_col: str = "normed", gain: Sequence[float] | None = None) -> DataFrame:
    """X / sqrt(mean(x²) + eps), per row, in double precision; with ``gain`` each
    dimension times its gain (one per dimension, else the row's result is null)."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    ms = F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y) / F.size(vec_col)
    out = F.transform(v, lambda x: x / F.sqrt(ms + F.lit(eps)))
    if gain is not None:
        weights = F.array(*[F.lit(float(g)) for g in gain])
        out = F.when(F.size(vec_col) == len(gain), F.zip_with(out, weights, lambda x, g: x * g))
    return df.withColumn(out_col, out)


def mean_vector(df: DataFrame, group_col: str, vec_col: str = "embedding",
                weight_col: str | None = None, out_col: str = "mean",
                sizes: tuple[int, int] | None = None) -> DataFrame:
    """(weighted) mean vector per group.

    Dimensions are exploded and averaged with partial aggregation, then each
    group's ≤ dim averages are gathered back in order (bounded by the dims).
    With ``sizes``, the least and largest size of a vector that is not empty, up to
    ``WIDE``, nothing is exploded: a group's sums are one row.
    """
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    if sizes is not None and sizes[1] <= WIDE:
        rows = df.where(F.size(vec_col) > 0).select(group_col, w.alias("_w"), F.col(vec_col).alias("_v"))
        some = range(sizes[0], sizes[1])  # dimensions that not every vector has
        sums = rows.groupBy(group_col).agg(
            F.max(F.size("_v")).alias("_n"), F.sum("_w").alias("_t"),
            *[F.sum(F.get("_v", F.lit(i)).cast("double") * F.col("_w")).alias(f"_s{i}") for i in range(sizes[1])],
            *[F.sum(F.when(F.size("_v") > i, F.col("_w"))).alias(f"_t{i}") for i in some])
        parts = [F.col(f"_s{i}") / F.col(f"_t{i}" if i in some else "_t") for i in range(sizes[1])]
        return sums.select(group_col, F.slice(F.array(*parts), F.lit(1), F.col("_n")).alias(out_col))
    ex = df.select(group_col, w.alias("_w"), F.posexplode(vec_col).alias("_i", "_x"))
    per = ex.groupBy(group_col, "_i").agg(
        (F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    return per.groupBy(group_col).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_parts")) \
        .select(group_col, F.transform("_parts", lambda p: p["_m"]).alias(out_col))


def embed_tokens(token_counts: DataFrame, embeddings: DataFrame, group_col: str,
                 id_col: str = "id", vec_id: str = "vec_id", vec_col: str = "embedding",
                 broadcast_bytes: int = 64 << 20) -> DataFrame:
    """C5 lookup: mean embedding of each group's tokens.

    ``token_counts`` is pre-aggregated (group, id, cnt), so a hot group costs
    at most one row per distinct id.  The embedding table, or else its rows that any
    token asks for, is broadcast only when its rows times its longest vector are within
    ``broadcast_bytes``; otherwise a shuffle join.  Before a broadcast join the counts are
    dealt by group, so that a group's vectors are added up where they are looked up.
    """
    has = F.when(F.size(vec_col) > 0, F.size(vec_col))
    n, least, dim = embeddings.agg(F.count(F.lit(1)), F.min(has), F.max(has)).first()
    emb = embeddings.select(F.col(vec_id).alias(id_col), vec_col)

    def small(n):
        return 8 * n * ((dim or 0) + 2) <= broadcast_bytes

    if not small(n):
        emb = cut_lineage(emb.join(token_counts.select(id_col).distinct(), id_col, "left_semi"))
        n = emb.count()
    if small(n):
        j = token_counts.repartition(group_col).join(F.broadcast(emb), id_col)
    else:
        j = token_counts.join(emb, id_col)
    return mean_vector(j, group_col, vec_col, weight_col="cnt", sizes=(least, dim) if dim else None)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, z: s + z)


def top_k_by_dot(vectors: DataFrame, queries: list[tuple[object, list[float]]], k: int,
                 id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query vector, the k vectors with the largest dot product.

    Output (query, id, score, rank); ties broken by id.  Queries are passed in
    chunks whose literal size is bounded; each chunk is one scan.
    """
    if not queries:
        raise ValueError("no query vectors")
    dim = max(1, len(queries[0][1]))
    per_chunk = max(1, MAX_LITERAL_VALUES // dim)
    n = vectors.count()
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    parts = []
    for c0 in range(0, len(queries), per_chunk):
        chunk = queries[c0:c0 + per_chunk]
        qlit = F.array(*[F.struct(F.lit(q).alias("q"),
                                  F.array(*[F.lit(float(x)) for x in vec]).alias("v"))
                         for q, vec in chunk])
        scored = vectors.select(id_col, F.explode(F.transform(
            qlit, lambda s: F.struct(s["q"].alias("query"), _dot(s["v"], F.col(vec_col)).alias("score"))
        )).alias("_s")).select(F.col("_s.query").alias("query"), id_col,
                               F.col("_s.score").alias("score"))
        # phase 1: top-k inside salted buckets (each ≤ ~BUCKET_ROWS rows per query)
        salted = scored.withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(buckets)))
        w1 = Window.partitionBy("query", "_b").orderBy(F.desc("score"), F.asc(id_col))
        cand = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
        # phase 2: ≤ k × buckets candidates per query
        w2 = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(id_col))
        parts.append(cand.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
                     .select("query", id_col, "score", "rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
