"""n-gram LM queries: model tables, perplexities, next-token filters, continuation.

Tokens are UTF-8 bytes (V = 256) so DuckDB can mirror every formula; the
operators take any id arrays (BPE ids work the same way).  Doubles are
rounded in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import byte_ids
from ..operators import ngram as G
from ..operators import pack as P
from ..operators import vocab_dist as D
from ..session import cut_lineage
from ..sources.tables import read_table
from .catalog import register
from .q_pack import SPLIT_LINES_SQL, WINDOW, WINDOWS_SQL, byte_offsets, split_lines

V, K = 256, 1.0
TEMP, TOPK, TOPP = 0.8, 5, 0.9
PPL_BATCH, PPL_MAX_BATCHES = 8, 100
NEW_TOKENS = 16
#: The byte whose positions masked_ppl leaves out.
MASKED = 32
DRAW_SEED, CONTINUE_SEED = 7, 11


def byte_seqs(spark, sf_dir, split):
    lines = split_lines(spark, sf_dir).where(F.col("split") == split)
    return lines.select("doc_id", "line_no", byte_ids("line").alias("ids"))


def train_bigram(spark, sf_dir):
    """The bigram table of the train split, materialized once (it is small —
    at most V² observed pairs) so scoring does not rescan the corpus per branch."""
    return cut_lineage(G.bigram_model(byte_seqs(spark, sf_dir, "train"), V, K))


TOKS_SQL = f"""
  SELECT split, doc_id, line_no,
         list_transform(regexp_extract_all(hex(encode(line)), '..'),
                        lambda h: CAST(('0x' || h) AS INTEGER)) AS ids
  FROM ({SPLIT_LINES_SQL})
"""
PAIRS_SQL = f"""
  SELECT split, doc_id, ids[i] AS a, ids[i + 1] AS b FROM ({TOKS_SQL}) t, range(1, len(ids)) r(i)
"""
BIGRAM_SQL = f"""
  SELECT a, b, n, ctx_n, (n + {K}) / (ctx_n + {K} * {V}) AS p FROM (
    SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS ctx_n FROM (
      SELECT a, b, count(*) AS n FROM ({PAIRS_SQL}) WHERE split = 'train' GROUP BY a, b))
"""


@register("bigram_model", oracle=f"""
SELECT a, b, n, CAST(ctx_n AS BIGINT) AS ctx_n, round(p, 9) AS p FROM ({BIGRAM_SQL})
""")
def q_bigram_model(spark, sf_dir):
    """Bigram table of the train split: counts, context totals, add-1 probability."""
    m = train_bigram(spark, sf_dir)
    return m.select("a", "b", "n", F.col("ctx_n").cast("long").alias("ctx_n"),
                    F.round("p", 9).alias("p"))


def _doc_ppl_select(df):
    return df.select("doc_id", "n_pos", F.round("nll", 6).alias("nll"), F.round("ppl", 6).alias("ppl"))


@register("bigram_ppl", oracle=f"""
WITH m AS ({BIGRAM_SQL}), c AS (SELECT DISTINCT a, ctx_n FROM m),
v AS (SELECT doc_id, a, b, count(*) AS cnt FROM ({PAIRS_SQL}) WHERE split = 'val' GROUP BY 1, 2, 3),
s AS (
  SELECT v.doc_id, sum(v.cnt) AS n_pos,
         sum(v.cnt * -ln(coalesce(m.p, {K} / (coalesce(c.ctx_n, 0) + {K} * {V})))) AS nll_sum
  FROM v LEFT JOIN m ON v.a = m.a AND v.b = m.b LEFT JOIN c ON v.a = c.a GROUP BY v.doc_id)
SELECT doc_id, CAST(n_pos AS BIGINT) AS n_pos, round(nll_sum / n_pos, 6) AS nll,
       round(exp(nll_sum / n_pos), 6) AS ppl FROM s
""")
def q_bigram_ppl(spark, sf_dir):
    """Per validation document, mean bigram nll and perplexity."""
    scored = G.score_bigram(byte_seqs(spark, sf_dir, "val"), train_bigram(spark, sf_dir), V, K)
    return _doc_ppl_select(G.perplexity(scored))


@register("unigram_ppl", oracle=f"""
WITH u AS (SELECT t, count(*) AS n FROM (SELECT unnest(ids) AS t FROM ({TOKS_SQL})
                                          WHERE split = 'train') GROUP BY t),
tot AS (SELECT sum(n) AS total FROM u),
v AS (SELECT doc_id, b, count(*) AS cnt FROM ({PAIRS_SQL}) WHERE split = 'val' GROUP BY 1, 2),
s AS (
  SELECT v.doc_id, sum(v.cnt) AS n_pos,
         sum(v.cnt * -ln((coalesce(u.n, 0) + {K}) / (tot.total + {K} * {V}))) AS nll_sum
  FROM v LEFT JOIN u ON v.b = u.t, tot GROUP BY v.doc_id)
SELECT doc_id, CAST(n_pos AS BIGINT) AS n_pos, round(nll_sum / n_pos, 6) AS nll,
       round(exp(nll_sum / n_pos), 6) AS ppl FROM s
""")
def q_unigram_ppl(spark, sf_dir):
    """Unigram baseline perplexity per validation document."""
    model, total = G.unigram_model(byte_seqs(spark, sf_dir, "train"), V, K)
    scored = G.score_unigram(byte_seqs(spark, sf_dir, "val"), model, total, V, K)
    return _doc_ppl_select(G.perplexity(scored))


@register("bigram_ppl_token", oracle=f"""
WITH m AS ({BIGRAM_SQL}), c AS (SELECT DISTINCT a, ctx_n FROM m),
v AS (SELECT a, b, count(*) AS cnt FROM ({PAIRS_SQL}) WHERE split = 'val' GROUP BY 1, 2)
SELECT CAST(sum(v.cnt) AS BIGINT) AS n_pos,
       round(exp(sum(v.cnt * -ln(coalesce(m.p, {K} / (coalesce(c.ctx_n, 0) + {K} * {V}))))
                 / sum(v.cnt)), 6) AS ppl
FROM v LEFT JOIN m ON v.a = m.a AND v.b = m.b LEFT JOIN c ON v.a = c.a
""")
def q_bigram_ppl_token(spark, sf_dir):
    """Token-weighted perplexity of the whole validation split."""
    scored = G.score_bigram(byte_seqs(spark, sf_dir, "val"), train_bigram(spark, sf_dir), V, K)
    return G.token_weighted_ppl(scored).select("n_pos", F.round("ppl", 6).alias("ppl"))


@register("masked_ppl", oracle=f"""
WITH m AS ({BIGRAM_SQL}), c AS (SELECT DISTINCT a, ctx_n FROM m),
pos AS (SELECT window_id, ids[i] AS a, ids[i + 1] AS b
        FROM (SELECT window_id, ids FROM ({WINDOWS_SQL}) WHERE split = 'val') w, range(1, len(ids)) r(i)
        WHERE ids[i] <> {MASKED})
SELECT window_id, count(*) AS n_pos, round(avg(nll), 6) AS nll, round(exp(avg(nll)), 6) AS ppl
FROM (SELECT window_id, -ln(coalesce(m.p, {K} / (coalesce(c.ctx_n, 0) + {K} * {V}))) AS nll
      FROM pos LEFT JOIN m ON pos.a = m.a AND pos.b = m.b LEFT JOIN c ON pos.a = c.a)
GROUP BY window_id
""")
def q_masked_ppl(spark, sf_dir):
    """Perplexity of every validation window whose positions after a space
    are masked: their input is negative, so their label is NULL and not scored."""
    win = P.windows(byte_offsets(spark, sf_dir, "val"), WINDOW)
    masked = win.withColumn("ids", F.transform("ids", lambda t: F.when(t == MASKED, -1).otherwise(t)))
    xy = P.xy(masked).withColumn("y", F.zip_with("x", F.slice("ids", 2, F.size("ids") - 1), lambda a, b: F.when(
        a >= 0, F.when(b < 0, MASKED).otherwise(b))))  # a masked input is still a label
    scored = G.perplexity(G.score_xy(xy, train_bigram(spark, sf_dir), V, K))
    return scored.select("window_id", "n_pos", F.round("nll", 6).alias("nll"), F.round("ppl", 6).alias("ppl"))


@register("bigram_ppl_batch", oracle=f"""
WITH m AS ({BIGRAM_SQL}), c AS (SELECT DISTINCT a, ctx_n FROM m),
w AS (SELECT window_id, ids FROM ({WINDOWS_SQL}) WHERE split = 'val'),
pos AS (SELECT window_id // {PPL_BATCH} AS batch_id, ids[i] AS a, ids[i + 1] AS b
        FROM w, range(1, len(ids)) r(i)),
l AS (
  SELECT batch_id, avg(-ln(coalesce(m.p, {K} / (coalesce(c.ctx_n, 0) + {K} * {V})))) AS loss
  FROM pos LEFT JOIN m ON pos.a = m.a AND pos.b = m.b LEFT JOIN c ON pos.a = c.a
  WHERE batch_id < {PPL_MAX_BATCHES} GROUP BY batch_id)
SELECT count(*) AS n_batches, round(avg(loss), 6) AS mean_loss, round(exp(avg(loss)), 6) AS ppl
FROM l
""")
def q_bigram_ppl_batch(spark, sf_dir):
    """exp(mean of per-batch mean losses) over the first 100 batches of
    8 validation windows (256 tokens, shifted once)."""
    win = P.windows(byte_offsets(spark, sf_dir, "val"), WINDOW)
    scored = G.score_bigram(win, train_bigram(spark, sf_dir), V, K, keys=["window_id"])
    out = G.batch_weighted_ppl(scored, PPL_BATCH, PPL_MAX_BATCHES)
    return out.select("n_batches", F.round("mean_loss", 6).alias("mean_loss"),
                      F.round("ppl", 6).alias("ppl"))


LOGITS_SQL = f"SELECT a AS ctx, b AS token, ln(p) AS logit, n FROM ({BIGRAM_SQL})"


@register("next_token_softmax", oracle=f"""
SELECT ctx, token, round(z / sum(z) OVER (PARTITION BY ctx), 9) AS prob
FROM (SELECT ctx, token, exp(l - max(l) OVER (PARTITION BY ctx)) AS z
      FROM (SELECT ctx, token, logit / {TEMP} AS l FROM ({LOGITS_SQL})))
""")
def q_next_token_softmax(spark, sf_dir):
    """H8/H9: temperature 0.8 then softmax over each context's continuations."""
    lg = G.next_token_logits(train_bigram(spark, sf_dir))
    lg = lg.withColumn("logit", G.temperature(F.col("logit"), TEMP))
    return G.softmax(lg).select("ctx", "token", F.round("prob", 9).alias("prob"))


@register("next_token_topk_ties", oracle=f"""
SELECT ctx, token, round(logit, 9) AS logit FROM (
  SELECT *, rank() OVER (PARTITION BY ctx ORDER BY logit DESC) AS r FROM ({LOGITS_SQL}))
WHERE r <= {TOPK}
""")
def q_topk_ties(spark, sf_dir):
    """top-5 continuations per context, ties at the 5th value kept."""
    lg = G.next_token_logits(train_bigram(spark, sf_dir))
    return G.top_k_ties(lg, TOPK).select("ctx", "token", F.round("logit", 9).alias("logit"))


@register("next_token_topk_exact", oracle=f"""
SELECT ctx, token, round(logit, 9) AS logit FROM (
  SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY logit DESC, token) AS r
  FROM ({LOGITS_SQL}))
WHERE r <= {TOPK}
""")
def q_topk_exact(spark, sf_dir):
    """exactly 5 continuations per context (ties to the smaller id)."""
    lg = G.next_token_logits(train_bigram(spark, sf_dir))
    return G.top_k_exact(lg, TOPK).select("ctx", "token", F.round("logit", 9).alias("logit"))


@register("next_token_topp", oracle=f"""
WITH s AS (
  SELECT ctx, token, z / sum(z) OVER (PARTITION BY ctx) AS prob
  FROM (SELECT ctx, token, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS z
        FROM ({LOGITS_SQL})))
SELECT ctx, token, round(prob, 9) AS prob FROM (
  SELECT *, coalesce(sum(prob) OVER (PARTITION BY ctx ORDER BY prob DESC, token
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s)
WHERE before < {TOPP} - 1e-12
""")
def q_topp(spark, sf_dir):
    """nucleus filter p = 0.9 over each context's softmax."""
    lg = G.softmax(G.next_token_logits(train_bigram(spark, sf_dir)))
    return G.top_p(lg, TOPP).select("ctx", "token", F.round("prob", 9).alias("prob"))


def _u(seed: int, *cols: str) -> str:
    """ngram.uniform01 in DuckDB."""
    text = " || '|' || ".join([f"'{seed}'", *(f"CAST({c} AS VARCHAR)" for c in cols)])
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)"


SAMPLE_DIST_SQL = f"""
  SELECT ctx, token, z / sum(z) OVER (PARTITION BY ctx) AS prob
  FROM (SELECT ctx, token, exp(l - max(l) OVER (PARTITION BY ctx)) AS z
        FROM (SELECT ctx, token, logit / {TEMP} AS l,
                     rank() OVER (PARTITION BY ctx ORDER BY logit DESC) AS r FROM ({LOGITS_SQL}))
        WHERE r <= {TOPK})
"""


@register("next_token_sample", oracle=f"""
SELECT ctx, arg_min(token, -ln({_u(DRAW_SEED, 'ctx', 'token')}) / prob) AS token
FROM ({SAMPLE_DIST_SQL}) GROUP BY ctx
""")
def q_next_token_sample(spark, sf_dir):
    """one seeded weighted draw per context after temperature + top-k."""
    lg = G.next_token_logits(train_bigram(spark, sf_dir))
    lg = lg.withColumn("logit", G.temperature(F.col("logit"), TEMP))
    dist = G.softmax(G.top_k_ties(lg, TOPK))
    return G.draw(dist, "prob", ["ctx"], "token", seed=DRAW_SEED)


def prompts(spark, sf_dir):
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return bench.select(F.col("item_id").alias("prompt_id"),
                        byte_ids("text").alias("ids")) \
        .where(F.size("ids") > 0)


@register("greedy_continue", oracle=f"""
WITH RECURSIVE
ch AS (SELECT ctx, token FROM (
         SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY logit DESC, token) AS r
         FROM ({LOGITS_SQL})) WHERE r = 1),
p AS (SELECT item_id AS prompt_id,
             list_transform(regexp_extract_all(hex(encode(text)), '..'),
                            lambda h: CAST(('0x' || h) AS INTEGER)) AS ids
      FROM benchmark),
g(prompt_id, step, ids) AS (
  SELECT prompt_id, 0, ids FROM p WHERE len(ids) > 0
  UNION ALL
  SELECT g.prompt_id, g.step + 1,
         CASE WHEN ch.token IS NULL THEN g.ids ELSE list_append(g.ids, CAST(ch.token AS INTEGER)) END
  FROM g LEFT JOIN ch ON ch.ctx = g.ids[len(g.ids)]
  WHERE g.step < {NEW_TOKENS})
SELECT prompt_id, ids FROM g WHERE step = {NEW_TOKENS}
""")
def q_greedy_continue(spark, sf_dir):
    """Continue every whole benchmark item by 16 greedy tokens."""
    choice = G.greedy(G.next_token_logits(train_bigram(spark, sf_dir)))
    return G.continue_greedy(prompts(spark, sf_dir), choice, NEW_TOKENS)


@register("sample_continue", oracle=f"""
WITH RECURSIVE
dist AS ({SAMPLE_DIST_SQL}),
nx AS (SELECT ctx, list(token ORDER BY token) AS tokens, list(prob ORDER BY token) AS probs
       FROM dist GROUP BY ctx),
p AS (SELECT item_id AS prompt_id,
             list_transform(regexp_extract_all(hex(encode(text)), '..'),
                            lambda h: CAST(('0x' || h) AS INTEGER)) AS ids
      FROM benchmark),
g(prompt_id, step, ids) AS (
  SELECT prompt_id, 0, ids FROM p WHERE len(ids) > 0
  UNION ALL
  SELECT prompt_id, step + 1, CASE WHEN tokens IS NULL THEN ids ELSE list_append(ids, CAST(
           tokens[list_position(ts, list_min(ts))] AS INTEGER)) END
  FROM (SELECT g.*, nx.tokens,
               [-ln({_u(CONTINUE_SEED, 'prompt_id', 'nx.tokens[i]', 'step')}) / nx.probs[i]
                FOR i IN range(1, len(nx.tokens) + 1)] AS ts
        FROM g LEFT JOIN nx ON nx.ctx = g.ids[len(g.ids)] WHERE g.step < {NEW_TOKENS}))
SELECT prompt_id, ids FROM g WHERE step = {NEW_TOKENS}
""")
def q_sample_continue(spark, sf_dir):
    """Sampled continuation of every whole benchmark item (T = 0.8, top-k 5
    with ties, seeded draws)."""
    lg = G.next_token_logits(train_bigram(spark, sf_dir))
    return G.continue_sampled(prompts(spark, sf_dir), lg, NEW_TOKENS, temp=TEMP, k=TOPK, seed=CONTINUE_SEED)


# ---------------------------------------------------------------------------
# the whole vocabulary: unseen tokens have their smoothed mass
# ---------------------------------------------------------------------------
WHOLE_SQL = f"""
  SELECT c.a AS ctx, v.t AS token, c.ctx_n, (coalesce(m.n, 0) + {K}) / (c.ctx_n + {K} * {V}) AS p, m.n IS NOT NULL AS known
  FROM (SELECT DISTINCT a, ctx_n FROM ({BIGRAM_SQL})) c
  JOIN (SELECT CAST(range AS INTEGER) AS t FROM range({V})) v ON true
  LEFT JOIN ({BIGRAM_SQL}) m ON m.a = c.a AND m.b = v.t
"""
WHOLE_SOFTMAX_SQL = f"""
  SELECT ctx, token, known, z / sum(z) OVER (PARTITION BY ctx) AS prob
  FROM (SELECT *, exp(ln(p) / {TEMP} - max(ln(p) / {TEMP}) OVER (PARTITION BY ctx)) AS z FROM ({WHOLE_SQL}))
"""


def whole_dist(spark, sf_dir):
    return D.whole_softmax(train_bigram(spark, sf_dir), V, K, TEMP)


@register("next_token_softmax_all", oracle=f"""
SELECT ctx, token, round(prob, 9) AS prob FROM ({WHOLE_SOFTMAX_SQL})
""")
def q_softmax_all(spark, sf_dir):
    """H8/H9: the softmax of each context over all 256 tokens, seen or not."""
    return D.tokens(whole_dist(spark, sf_dir)).select("ctx", "token", F.round("prob", 9).alias("prob"))


@register("next_token_topp_all", oracle=f"""
SELECT ctx, token, round(prob, 9) AS prob FROM (
  SELECT *, coalesce(sum(prob) OVER (PARTITION BY ctx ORDER BY round(prob, 14) DESC, token
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ({WHOLE_SOFTMAX_SQL}))
WHERE before < {TOPP} - 1e-12
""")
def q_topp_all(spark, sf_dir):
    """nucleus 0.9 over all 256 tokens."""
    return D.tokens(D.top_p(whole_dist(spark, sf_dir), TOPP)).select("ctx", "token", F.round("prob", 9).alias("prob"))


@register("next_token_topk_all", oracle=f"""
SELECT ctx, token, round(prob, 9) AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY round(prob, 14) DESC, token) AS r
  FROM ({WHOLE_SOFTMAX_SQL})) WHERE r <= 40
""")
def q_topk_all(spark, sf_dir):
    """exactly 40 tokens per context; contexts with fewer seen ones go on with unseen."""
    return D.tokens(D.top_k_exact(whole_dist(spark, sf_dir), 40)) \
        .select("ctx", "token", F.round("prob", 9).alias("prob"))


@register("next_token_sample_all", oracle=f"""
WITH s AS ({WHOLE_SOFTMAX_SQL}),
r AS (SELECT ctx, count(*) AS rest, max(prob) AS rest_p, list(token ORDER BY token) AS unseen
      FROM s WHERE NOT known GROUP BY ctx),
race AS (
  SELECT ctx, token, -ln({_u(DRAW_SEED, 'ctx', 'token')}) / prob AS t FROM s WHERE known
  UNION ALL
  SELECT ctx, unseen[CAST(floor({_u(DRAW_SEED, 'ctx', "'which'")} * rest) AS BIGINT) + 1],
         -ln({_u(DRAW_SEED, 'ctx', "'rest'")}) / (rest * rest_p) FROM r)
SELECT ctx, arg_min(token, t) AS token FROM race GROUP BY ctx
""")
def q_sample_all(spark, sf_dir):
    """one seeded draw per context over all 256 tokens."""
    return D.draw(whole_dist(spark, sf_dir), DRAW_SEED)


@register("sample_continue_all")
def q_sample_continue_all(spark, sf_dir):
    """Every benchmark item continued by 16 draws over the whole vocabulary (T = 0.8,
    nucleus 0.9)."""
    return D.continue_sampled(prompts(spark, sf_dir), D.top_p(whole_dist(spark, sf_dir), TOPP), V, NEW_TOKENS,
                              seed=CONTINUE_SEED)
