"""Vector queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import byte_ids
from ..operators import vector_search as VS
from ..operators import vectors as Vx
from ..sources.tables import read_table
from .catalog import register

TOPK = 10
IDS_SQL = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(('0x' || h) AS INTEGER))"


def _round_vec(col, nd=6):
    return F.transform(col, lambda x: F.round(x, nd))


@register("rms_norm", oracle="""
SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(
         list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) / len(embedding)
         + 1e-5), 6)) AS normed
FROM embeddings
""")
def q_rms_norm(spark, sf_dir):
    """RMS-normalized embedding rows (eps 1e-5)."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return Vx.rms_norm(emb).select("vec_id", _round_vec("normed").alias("normed"))


LABEL_MEAN_SQL = """
  SELECT label, i, avg(embedding[i]::DOUBLE) AS m
  FROM embeddings, range(1, len(embedding) + 1) r(i) GROUP BY label, i
"""


@register("mean_vector", oracle=f"""
SELECT label, list(round(m, 6) ORDER BY i) AS mean FROM ({LABEL_MEAN_SQL}) GROUP BY label
""")
def q_mean_vector(spark, sf_dir):
    """Mean embedding per label."""
    emb = read_table(spark, sf_dir, "embeddings", ["label", "embedding"])
    return Vx.mean_vector(emb, "label").select("label", _round_vec("mean").alias("mean"))


@register("vector_topk", oracle=f"""
WITH m AS ({LABEL_MEAN_SQL}),
s AS (SELECT m.label AS query, e.vec_id, sum(e.embedding[m.i]::DOUBLE * m.m) AS score
      FROM embeddings e, m GROUP BY 1, 2)
SELECT query, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s) WHERE rank <= {TOPK}
""")
def q_vector_topk(spark, sf_dir):
    """The 10 vectors with the largest dot product with each label's mean."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "label", "embedding"])
    means = Vx.mean_vector(emb, "label").collect()  # one row per label (checked in chunks)
    queries = [(int(r["label"]), list(r["mean"])) for r in means]
    out = Vx.top_k_by_dot(emb.select("vec_id", "embedding"), queries, TOPK)
    return out.select(F.col("query").cast("int").alias("query"), "vec_id",
                      F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@register("doc_embedding", oracle=f"""
WITH t AS (SELECT doc_id, id, count(*) AS cnt
           FROM (SELECT doc_id, unnest({IDS_SQL}) AS id FROM documents) GROUP BY 1, 2),
j AS (SELECT t.doc_id, i, sum(t.cnt * e.embedding[i]::DOUBLE) / sum(t.cnt) AS m
      FROM t JOIN embeddings e ON e.vec_id = t.id, range(1, len(e.embedding) + 1) r(i)
      GROUP BY 1, 2)
SELECT doc_id, list(round(m, 6) ORDER BY i) AS mean FROM j GROUP BY doc_id
""")
def q_doc_embedding(spark, sf_dir):
    """C5 lookup: each document's mean embedding over its byte-token ids."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    counts = docs.select("doc_id", F.explode(byte_ids("text")).alias("id")) \
        .groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("cnt"))
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    out = Vx.embed_tokens(counts, emb, "doc_id")
    return out.select("doc_id", _round_vec("mean").alias("mean"))


@register("vector_search", oracle=f"""
SELECT query, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query, e.vec_id, s.score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON len(q.embedding) = len(e.embedding),
       LATERAL (SELECT round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score) s
  WHERE q.vec_id % 100 = 0) WHERE rank <= {TOPK}
""")
def q_vector_search(spark, sf_dir):
    """The 10 vectors with the largest dot product for every vec_id divisible by 100,
    against all rows."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    out = VS.search(emb, emb.where("vec_id % 100 = 0"), TOPK)
    return out.select("query", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"),
                      F.col("rank").cast("int").alias("rank"))


#: Gains of the registered norm: 1, 1.01, 1.02, ... for the dimensions in order.
GAIN_STEP = 0.01


@register("rms_norm_gain", oracle=f"""
SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: round((1 + {GAIN_STEP} * (i - 1))
         * embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))
         / len(embedding) + 1e-5), 6)) AS normed
FROM embeddings
""")
def q_rms_norm_gain(spark, sf_dir):
    """RMS-normalized embedding rows times a gain per dimension."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    dim = emb.agg(F.max(F.size("embedding"))).first()[0] or 0
    gain = [1 + GAIN_STEP * i for i in range(dim)]
    return Vx.rms_norm(emb, gain=gain).select("vec_id", _round_vec("normed").alias("normed"))
