"""Distributions over the whole vocabulary against plain Python over all V tokens."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import ngram, vocab_dist as D

V, K = 20, 0.5


@pytest.fixture(scope="module")
def seqs():
    pick = random.Random(4)
    return [[pick.randrange(9) for _ in range(pick.randrange(1, 12))] for _ in range(40)]


@pytest.fixture(scope="module")
def model(spark, seqs):
    return ngram.bigram_model(spark.createDataFrame([(s,) for s in seqs], "ids array<int>"), V, K).cache()


def whole(seqs, temp):
    n = {}
    for s in seqs:
        for a, b in zip(s, s[1:]):
            n.setdefault(a, [0] * V)[b] += 1
    out = {}
    for a, row in n.items():
        z = [math.exp(math.log((c + K) / (sum(row) + K * V)) / temp) for c in row]
        out[a] = {t: x / sum(z) for t, x in enumerate(z)}
    return out


def table(df):
    out = {}
    for r in df.collect():
        assert r.token not in out.setdefault(r.ctx, {})
        out[r.ctx][r.token] = r.prob
    return out


def same(got, want):
    assert {c: set(d) for c, d in got.items()} == {c: set(d) for c, d in want.items()}
    assert all(abs(p - want[c][t]) < 1e-9 for c, d in got.items() for t, p in d.items())


@pytest.mark.parametrize("temp", [1.0, 0.3, 2.5])
def test_softmax_covers_the_vocabulary(model, seqs, temp):
    got = table(D.tokens(D.whole_softmax(model, V, K, temp)))
    same(got, whole(seqs, temp))
    assert all(abs(sum(d.values()) - 1) < 1e-9 and len(d) == V for d in got.values())


def _order(d):
    return sorted(d, key=lambda t: (-round(d[t], 13), t))


@pytest.mark.parametrize("k", [1, 3, 8, 19, 50])
def test_top_k(model, seqs, k):
    want = whole(seqs, 1.0)
    dist = D.whole_softmax(model, V, K)
    same(table(D.tokens(D.top_k_exact(dist, k))), {c: {t: d[t] for t in _order(d)[:k]} for c, d in want.items()})
    ties = {c: {t: p for t, p in d.items() if p >= d[_order(d)[min(k, V) - 1]] - 1e-13} for c, d in want.items()}
    same(table(D.tokens(D.top_k_ties(dist, k))), ties)


@pytest.mark.parametrize("p", [0.05, 0.5, 0.93, 1.0])
def test_top_p(model, seqs, p):
    want = {}
    for c, d in whole(seqs, 1.0).items():
        mass, kept = 0.0, {}
        for t in _order(d):
            if mass >= p - 1e-9:
                break
            kept[t] = d[t]
            mass += d[t]
        want[c] = kept
    same(table(D.tokens(D.top_p(D.whole_softmax(model, V, K), p, eps=1e-9))), want)


def test_unseen_tokens_can_be_drawn_as_often_as_they_should(spark, model, seqs):
    want = whole(seqs, 1.0)
    ctx = min(want)
    dist = D.whole_softmax(model, V, K).where(F.col("ctx") == ctx)
    draws = dist.join(spark.range(20_000), how="cross") \
        .select(D.drawn([F.col("id")], 9).alias("token")).groupBy("token").count().collect()
    got = {r.token: r["count"] / 20_000 for r in draws}
    assert all(abs(got.get(t, 0) - p) < 0.015 for t, p in want[ctx].items())
    assert sum(p for t, p in got.items() if t >= 9) > 0


def test_continuation_draws_from_the_kept_tokens(spark, model, seqs):
    dist = D.top_p(D.whole_softmax(model, V, K), 0.8)
    kept = {c: set(d) for c, d in table(D.tokens(dist)).items()}
    prompts = spark.createDataFrame([(i, [i % V]) for i in range(60)] + [(99, [])], "prompt_id long, ids array<int>")
    rows = {r.prompt_id: r.ids for r in D.continue_sampled(prompts, dist, V, 10, seed=1).collect()}
    assert rows[99] == [] and all(len(rows[i]) == 11 for i in range(60))
    for ids in rows.values():
        assert all(b in kept.get(a, range(V)) for a, b in zip(ids, ids[1:]))
    again = {r.prompt_id: r.ids for r in D.continue_sampled(prompts.repartition(3), dist, V, 10, seed=1).collect()}
    assert again == rows
