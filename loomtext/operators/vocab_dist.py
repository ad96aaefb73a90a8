"""Next-token distributions over the whole vocabulary.

A smoothed model gives every unseen token of a context the same probability.  So one row
per context holds all V of them: ``seen``, the observed tokens by falling probability
(then id), and ``rest`` unseen ones of probability ``rest_p`` each.  Cut-offs and draws
work on both.  A kept part of the unseen tokens is always their first ids.

  dist : (ctx, ids array<int> ascending, seen array<struct<p,token>>, rest long, rest_p double)

``ids`` are all observed tokens, also cut ones, so the unseen can be told.  A row holds at
most V tokens.  Ids run from 0 to V - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ngram import uniform01

EPS = 1e-12
_LAYOUT = ("ctx", "ids", "seen", "rest", "rest_p")


def whole_softmax(model: DataFrame, vocab_size: int, k: float = 1.0, temp: float = 1.0) -> DataFrame:
    """H8 + H9 over all V tokens, from ``bigram_model`` rows (a, b, ctx_n, p)."""
    t = max(1e-6, float(temp))
    rows = model.groupBy(F.col("a").alias("ctx")).agg(
        F.sort_array(F.collect_list(F.struct((F.log("p") / t).alias("l"), (-F.col("b")).alias("neg"))), asc=False)
        .alias("s"), F.max("ctx_n").alias("ctx_n"))
    top = F.col("s")[0]["l"]
    default = F.log(F.lit(float(k)) / (F.col("ctx_n") + k * vocab_size)) / t
    rows = rows.select(
        "ctx", F.transform("s", lambda x: F.struct(F.exp(x["l"] - top).alias("p"),
                                                   (-x["neg"]).cast("int").alias("token"))).alias("seen"),
        (F.lit(int(vocab_size)) - F.size("s")).cast("long").alias("rest"),
        F.exp(default - top).alias("rest_p"))
    return normalized(rows.withColumn("ids", F.array_sort(F.col("seen.token"))))


def _mass(seen: Column) -> Column:
    return F.aggregate(seen, F.lit(0.0), lambda s, x: s + x["p"])


def normalized(dist: DataFrame) -> DataFrame:
    """Probabilities that sum to 1 over what is kept."""
    total = dist.withColumn("_t", _mass(F.col("seen")) + F.col("rest") * F.col("rest_p"))
    return total.select("ctx", "ids", F.transform("seen", lambda x: F.struct(
        (x["p"] / F.col("_t")).alias("p"), x["token"].alias("token"))).alias("seen"),
        "rest", (F.col("rest_p") / F.col("_t")).alias("rest_p"))


def top_k_ties(dist: DataFrame, k: int | None) -> DataFrame:
    """tokens as probable as the k-th; all unseen ones tie.  None or 0: off."""
    if not k:
        return dist
    full = F.size("seen") >= k
    least = F.element_at("seen", F.least(F.lit(int(k)), F.size("seen")))["p"]
    return dist.withColumn("seen", F.when(full, F.filter("seen", lambda x: x["p"] >= least))
                           .otherwise(F.col("seen"))) \
        .withColumn("rest", F.when(full, F.lit(0).cast("long")).otherwise(F.col("rest"))).select(*_LAYOUT)


def top_k_exact(dist: DataFrame, k: int) -> DataFrame:
    """exactly k tokens (fewer if V is less), ties to the smaller id."""
    left = F.greatest(F.lit(int(k)) - F.size("seen"), F.lit(0)).cast("long")
    return dist.select("ctx", "ids", F.slice("seen", 1, int(k)).alias("seen"),
                       F.least("rest", left).alias("rest"), "rest_p")


def top_p(dist: DataFrame, p: float, eps: float = EPS) -> DataFrame:
    """tokens while the mass before them is under p; unseen ones by id."""
    limit = float(p) - eps
    walked = F.aggregate(
        "seen", F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("n")),
        lambda s, x: F.struct((s["m"] + x["p"]).alias("m"),
                              (s["n"] + F.when(s["m"] < limit, 1).otherwise(0)).alias("n")))
    rows = dist.withColumn("_w", walked)
    more = F.greatest(F.ceil((F.lit(limit) - F.col("_w.m")) / F.col("rest_p")), F.lit(0)).cast("long")
    return rows.select("ctx", "ids", F.slice("seen", F.lit(1), F.col("_w.n")).alias("seen"),
                       F.least("rest", more).alias("rest"), "rest_p")


def unseen_at(ids: Column, index: Column) -> Column:
    """The id at ``index`` among those that are not in ``ids`` (ascending)."""
    return F.aggregate(ids, index.cast("long"), lambda at, s: F.when(s <= at, at + 1).otherwise(at)).cast("int")


def drawn(keys: list[Column], seed: int, ids: str = "ids", seen: str = "seen", rest: str = "rest",
          rest_p: str = "rest_p") -> Column:
    """one weighted draw in the row.  The seen tokens race with exponential times;
    the unseen run as one, at the sum of their rates, and a second number tells which."""
    race = F.transform(seen, lambda x: F.struct(
        (-F.log(uniform01(*keys, x["token"], seed=seed)) / x["p"]).alias("t"), x["token"].alias("token")))
    other = F.struct((-F.log(uniform01(*keys, F.lit("rest"), seed=seed)) / (F.col(rest) * F.col(rest_p))).alias("t"),
                     unseen_at(F.col(ids), F.floor(uniform01(*keys, F.lit("which"), seed=seed) * F.col(rest)))
                     .alias("token"))
    return F.array_min(F.when(F.col(rest) > 0, F.concat(race, F.array(other))).otherwise(race))["token"]


def draw(dist: DataFrame, seed: int = 0) -> DataFrame:
    """(ctx, token): one draw per context."""
    return normalized(dist).select("ctx", drawn([F.col("ctx")], seed).alias("token"))


def tokens(dist: DataFrame) -> DataFrame:
    """(ctx, token, prob) of every kept token, unseen ones too."""
    unseen = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1),
                         lambda i: F.struct(F.col("rest_p").alias("p"), unseen_at(F.col("ids"), i).alias("token")))
    every = F.when(F.col("rest") > 0, F.concat("seen", unseen)).otherwise(F.col("seen"))
    return dist.select("ctx", F.inline(every)).select("ctx", "token", F.col("p").alias("prob"))


def continue_sampled(prompts: DataFrame, dist: DataFrame, vocab_size: int, max_new_tokens: int, seed: int = 0,
                     key: str = "prompt_id", ids_col: str = "ids", checkpoint_every: int = 8,
                     broadcast_contexts: int = 100_000) -> DataFrame:
    """Every step draws the next token of each prompt over the whole vocabulary.

    A last token that the model never saw as a context is followed by any of the V.
    ``dist`` is broadcast up to ``broadcast_contexts`` rows, else joined by a shuffle;
    an empty prompt keeps its length.
    """
    table = cut_lineage(normalized(dist)).select(
        F.col("ctx").alias("_ctx"), F.col("ids").alias("_ids"), F.col("seen").alias("_seen"),
        F.col("rest").alias("_rest"), F.col("rest_p").alias("_rest_p"))
    cells = table.agg(F.sum(F.size("_ids") + 1)).first()[0] or 0
    if cells <= 10 * broadcast_contexts:
        table = F.broadcast(table)
    cur = prompts.select(key, ids_col)
    for step in range(max_new_tokens):
        keys = [F.col(key), F.lit(step)]
        anything = F.floor(uniform01(*keys, F.lit("any"), seed=seed) * vocab_size).cast("int")
        nxt = F.when(F.col("_seen").isNull(), anything) \
            .otherwise(drawn(keys, seed, "_ids", "_seen", "_rest", "_rest_p"))
        cur = cur.withColumn("_ctx", F.try_element_at(ids_col, F.lit(-1))).join(table, "_ctx", "left") \
            .select(key, F.when(F.size(ids_col) > 0, F.concat(ids_col, F.array(nxt)))
                    .otherwise(F.col(ids_col)).alias(ids_col))
        if (step + 1) % checkpoint_every == 0:
            cur = cut_lineage(cur)
    return cur
