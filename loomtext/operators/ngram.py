"""Count-based language-model statistics.

The reference scores text with a neural model; the table-shaped semantics we
rebuild are its loss, perplexity, next-token filtering and sampling rules,
over an add-k smoothed n-gram model learned from the train split:

  unigram  p(t)   = (c(t) + k) / (N + k·V)
  bigram   p(b|a) = (c(a,b) + k) / (c(a,·) + k·V)

Positions 2..T of every sequence are scored (the first token is never
predicted).  All per-context operators partition by context; a context group
holds at most V continuations (V = vocabulary size, a parameter), so no
group grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


# ---------------------------------------------------------------------------
# models
# ---------------------------------------------------------------------------
def adjacent_id_pairs(seqs: DataFrame, ids_col: str = "ids", keep: Sequence[str] = ()) -> DataFrame:
    """E1 on id arrays: one row per scored position (a = previous, b = target)."""
    t = F.col(ids_col)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    z = F.arrays_zip(F.slice(t, 1, n).alias("a"), F.slice(t, 2, n).alias("b"))
    return seqs.select(*keep, F.explode(z).alias("_p")) \
               .select(*keep, F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))


def bigram_counts(train: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(a, b, n) over adjacent positions — partial aggregation before the shuffle."""
    return adjacent_id_pairs(train, ids_col).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def bigram_model(train: DataFrame, vocab_size: int, k: float = 1.0,
                 ids_col: str = "ids") -> DataFrame:
    """Observed bigrams with smoothed probability: (a, b, n, ctx_n, p)."""
    counts = bigram_counts(train, ids_col)
    ctx = Window.partitionBy("a")  # a context group ≤ V rows
    return counts.withColumn("ctx_n", F.sum("n").over(ctx)) \
                 .withColumn("p", (F.col("n") + k) / (F.col("ctx_n") + k * vocab_size))


def unigram_model(train: DataFrame, vocab_size: int, k: float = 1.0,
                  ids_col: str = "ids") -> tuple[DataFrame, int]:
    """(t, n, p) over all train tokens, and N (one scalar)."""
    counts = train.select(F.explode(ids_col).alias("t")).groupBy("t") \
                  .agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("p", (F.col("n") + k) / F.lit(total + k * vocab_size)), int(total)


# ---------------------------------------------------------------------------
# scoring
# ---------------------------------------------------------------------------
def score_bigram(seqs: DataFrame, model: DataFrame, vocab_size: int, k: float = 1.0,
                 keys: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """Per scored position group → (keys, n_pos, nll_sum).

    Positions are pre-aggregated to (keys, a, b, cnt) before joining the model
    so repeated pairs cost one row; unseen pairs fall back to the smoothing
    mass k / (c(a,·) + kV) (or 1/V for an unseen context).
    """
    keys = list(keys)
    pos = adjacent_id_pairs(seqs, ids_col, keys).groupBy(*keys, "a", "b") \
        .agg(F.count(F.lit(1)).alias("cnt"))
    ctx = model.select("a", "ctx_n").distinct()
    j = pos.join(model.select("a", "b", "p"), ["a", "b"], "left").join(ctx, "a", "left")
    p = F.coalesce(F.col("p"), F.lit(k) / (F.coalesce(F.col("ctx_n"), F.lit(0)) + k * vocab_size))
    return j.groupBy(*keys).agg(F.sum("cnt").alias("n_pos"),
                                F.sum(F.col("cnt") * -F.log(p)).alias("nll_sum"))


def score_unigram(seqs: DataFrame, model: DataFrame, total: int, vocab_size: int,
                  k: float = 1.0, keys: Sequence[str] = ("doc_id",),
                  ids_col: str = "ids") -> DataFrame:
    """Unigram twin of ``score_bigram`` (targets = positions 2..T)."""
    keys = list(keys)
    pos = adjacent_id_pairs(seqs, ids_col, keys).groupBy(*keys, "b") \
        .agg(F.count(F.lit(1)).alias("cnt"))
    j = pos.join(model.select(F.col("t").alias("b"), "p"), "b", "left")
    p = F.coalesce(F.col("p"), F.lit(k / (total + k * vocab_size)))
    return j.groupBy(*keys).agg(F.sum("cnt").alias("n_pos"),
                                F.sum(F.col("cnt") * -F.log(p)).alias("nll_sum"))


def score_xy(xy: DataFrame, model: DataFrame, vocab_size: int, k: float = 1.0,
             keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """D5/D6 from (x, y): (keys, n_pos, nll_sum); a NULL label (B8) is no position.

    Pairs are counted per group before they meet the model."""
    keys = list(keys)
    pos = xy.select(*keys, F.explode(F.arrays_zip("x", "y")).alias("z")).where("z.y is not null") \
        .groupBy(*keys, F.col("z.x").alias("a"), F.col("z.y").alias("b")).agg(F.count(F.lit(1)).alias("cnt"))
    ctx = model.select("a", "ctx_n").distinct()
    j = pos.join(model.select("a", "b", "p"), ["a", "b"], "left").join(ctx, "a", "left")
    p = F.coalesce(F.col("p"), F.lit(k) / (F.coalesce(F.col("ctx_n"), F.lit(0)) + k * vocab_size))
    return j.groupBy(*keys).agg(F.sum("cnt").alias("n_pos"), F.sum(F.col("cnt") * -F.log(p)).alias("nll_sum"))


def perplexity(scored: DataFrame) -> DataFrame:
    """Per group: mean nll and its exp (D5 + H10)."""
    nll = F.col("nll_sum") / F.col("n_pos")
    return scored.withColumn("nll", nll).withColumn("ppl", F.exp(nll))


def token_weighted_ppl(scored: DataFrame) -> DataFrame:
    """exp(Σ nll / Σ positions) over everything scored."""
    return scored.agg(F.sum("n_pos").alias("n_pos"), F.sum("nll_sum").alias("nll_sum")) \
        .withColumn("ppl", F.exp(F.col("nll_sum") / F.col("n_pos")))


def batch_weighted_ppl(scored_windows: DataFrame, batch_size: int, max_batches: int | None = None,
                       window_col: str = "window_id") -> DataFrame:
    """D6 (T13) + F7: batch loss = mean nll over the batch's positions; the
    perplexity is exp(mean of batch losses) over the first ``max_batches``
    batches (a filter on the batch id, never a bare LIMIT).  No batch → +inf."""
    b = scored_windows.withColumn("batch_id", F.floor(F.col(window_col) / batch_size))
    if max_batches is not None:
        b = b.where(F.col("batch_id") < max_batches)
    per = b.groupBy("batch_id").agg((F.sum("nll_sum") / F.sum("n_pos")).alias("loss"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("loss").alias("mean_loss")) \
        .withColumn("ppl", F.when(F.col("n_batches") > 0, F.exp("mean_loss"))
                    .otherwise(F.lit(float("inf"))))


# ---------------------------------------------------------------------------
# next-token distributions
# ---------------------------------------------------------------------------
def next_token_logits(model: DataFrame) -> DataFrame:
    """(ctx, token, logit = ln p(token | ctx)) for observed continuations."""
    return model.select(F.col("a").alias("ctx"), F.col("b").alias("token"),
                        F.log("p").alias("logit"))


def temperature(logit: Column, t: float) -> Column:
    """H8: logit / max(1e-6, T)."""
    return logit / F.lit(max(1e-6, float(t)))


def softmax(df: DataFrame, logit_col: str = "logit", by: str = "ctx", out: str = "prob") -> DataFrame:
    """H9: exp(l − max l) / Σ exp(l − max l) within each context."""
    w = Window.partitionBy(by)
    z = F.exp(F.col(logit_col) - F.max(logit_col).over(w))
    return df.withColumn("_z", z).withColumn(out, F.col("_z") / F.sum("_z").over(w)).drop("_z")


def top_k_ties(df: DataFrame, k: int | None, score: str = "logit", by: str = "ctx") -> DataFrame:
    """keep values ≥ the k-th largest (ties kept); k clamped; None/0 = off."""
    if not k:
        return df
    w = Window.partitionBy(by).orderBy(F.desc(score))
    return df.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")


def top_k_exact(df: DataFrame, k: int, score: str = "logit", by: str = "ctx",
                tie: str = "token") -> DataFrame:
    """exactly k rows per context (ties broken by ``tie`` ascending)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def top_p(df: DataFrame, p: float, prob: str = "prob", by: str = "ctx", tie: str = "token",
          eps: float = 1e-12) -> DataFrame:
    """nucleus — keep rows while the mass strictly before them is < p.

    ``eps`` absorbs floating error when the exact mass equals p (common with
    small counts), so that case is excluded as exact arithmetic would."""
    w = Window.partitionBy(by).orderBy(F.desc(prob), F.asc(tie)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(prob).over(w), F.lit(0.0))
    return df.withColumn("_before", before).where(F.col("_before") < p - eps).drop("_before")


def uniform01(*cols: Column, seed: int = 0) -> Column:
    """Deterministic U(0,1): the first 52 bits of md5('seed|col|col…')."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def draw(df: DataFrame, prob: str = "prob", by: Sequence[str] = ("ctx",), token: str = "token",
         seed: int = 0, extra: Sequence[Column] = ()) -> DataFrame:
    """one weighted draw per group via exponential races:
    argmin over tokens of −ln(u)/p, u hashed from (seed, group, token, extra).
    Order-independent and reproducible; P(token) = p."""
    by = list(by)
    u = uniform01(*[F.col(c) for c in by], F.col(token), *extra, seed=seed)
    keyed = df.withColumn("_key", -F.log(u) / F.col(prob))
    return keyed.groupBy(*by).agg(F.min_by(token, "_key").alias(token))


def greedy(df: DataFrame, score: str = "logit", by: str = "ctx", token: str = "token") -> DataFrame:
    """argmax per context (= top-k exact with k = 1)."""
    return top_k_exact(df, 1, score, by, token).select(by, token)


# ---------------------------------------------------------------------------
# batch continuation
# ---------------------------------------------------------------------------
def continue_greedy(prompts: DataFrame, choice: DataFrame, max_new_tokens: int,
                    key: str = "prompt_id", ids_col: str = "ids",
                    checkpoint_every: int = 8) -> DataFrame:
    """I7 greedy: append argmax(next | last token) ``max_new_tokens`` times.

    ``choice`` is (ctx, token), one row per context (bounded by V).  A prompt
    whose last token has no continuation keeps its length (generation stops).
    Each step is one join of the prompts with the choice table.
    """
    cur = prompts.select(key, ids_col)
    for step in range(max_new_tokens):
        last = F.element_at(ids_col, -1)
        nxt = cur.withColumn("_ctx", last).join(
            F.broadcast(choice.select(F.col("ctx").alias("_ctx"), F.col("token").alias("_nt"))),
            "_ctx", "left")
        cur = nxt.select(key, F.when(F.col("_nt").isNotNull(),
                                     F.concat(ids_col, F.array(F.col("_nt").cast("int"))))
                         .otherwise(F.col(ids_col)).alias(ids_col))
        if (step + 1) % checkpoint_every == 0:
            cur = cut_lineage(cur)
    return cur


def continue_sampled(prompts: DataFrame, logits: DataFrame, max_new_tokens: int,
                     temp: float = 1.0, k: int | None = 50, seed: int = 0,
                     key: str = "prompt_id", ids_col: str = "ids",
                     checkpoint_every: int = 8) -> DataFrame:
    """I7 sampled: temperature (H8, floored), top-k with ties (F2), softmax
    (H9), one seeded draw per prompt and step (F6), made in the prompt's row over
    its context's candidates; every step adds one broadcast join to the plan."""
    dist = softmax(top_k_ties(logits.withColumn("logit", temperature(F.col("logit"), temp)), k))
    # One row per context (at most V), with its candidates: at most V of them.
    table = cut_lineage(dist.groupBy("ctx").agg(
        F.array_sort(F.collect_list(F.struct("token", "prob"))).alias("_next"))) \
        .withColumnRenamed("ctx", "_ctx")
    cur = prompts.select(key, ids_col)
    for step in range(max_new_tokens):
        race = F.array_min(F.transform("_next", lambda c: F.struct(
            (-F.log(uniform01(F.col(key), c["token"], F.lit(step), seed=seed)) / c["prob"]).alias("t"),
            c["token"].alias("token"))))
        cur = cur.withColumn("_ctx", F.element_at(ids_col, -1)).join(F.broadcast(table), "_ctx", "left") \
            .select(key, F.when(F.col("_next").isNotNull(),
                                F.concat(ids_col, F.array(race["token"].cast("int"))))
                    .otherwise(F.col(ids_col)).alias(ids_col))
        if (step + 1) % checkpoint_every == 0:
            cur = cut_lineage(cur)
    return cur
