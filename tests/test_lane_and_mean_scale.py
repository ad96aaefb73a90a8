"""What a lane holds of a micro-batch, and what a mean of vectors sends through a shuffle."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from loomtext.operators import vectors
from loomtext.streaming import shards


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_a_lane_does_not_hold_the_tokens_of_its_micro_batch():
    def batches():
        for k in range(40):
            yield pd.DataFrame({"_end": False, "_o0": np.arange(1000) * 40 + k,
                                "ids": [np.full(500, k, np.int32)] * 1000})

    state, n = State(), 0
    tracemalloc.start()
    for frame in shards._packer(4000, ["_o0"])(("train", 0), batches(), state):
        n += int(frame["n_tokens"].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40 * 1000 * 500
    assert peak < 40 << 20  # the tokens are 80 MB


ROWS = [(1, "a"), (2, "a"), (7, "a"), (2, "b"), (3, "b"), (4, "b"), (9, "c"), (1, None), (3, None), (5, "d"), (5, "e"), (1, "e")]
VECTORS = [(1, [1.0, 2.0, 3.0]), (2, [0.5, None, 4.0]), (2, [2.0, 2.0]), (3, [5.0]), (4, None), (5, []), (7, [1.0, 1.0, 8.0]), (None, [9.0])]


def brute():
    sums = {}
    for k, (i, g) in enumerate(ROWS):
        for j, v in VECTORS:
            for d, x in enumerate(v or []) if i == j else ():
                s = sums.setdefault(g, {}).setdefault(d, [0.0, 0.0])
                s[0] += 0 if x is None else x * (k + 1)
                s[1] += k + 1
    return {g: [s[d][0] / s[d][1] for d in sorted(s)] for g, s in sums.items()}


@pytest.mark.parametrize("wide", [512, 1])
@pytest.mark.parametrize("limit", [64 << 20, 160, 1])
def test_means_of_looked_up_vectors(spark, monkeypatch, wide, limit):
    monkeypatch.setattr(vectors, "WIDE", wide)
    counts = spark.createDataFrame([(g, i, k + 1) for k, (i, g) in enumerate(ROWS)], "g string, id int, cnt long")
    table = spark.createDataFrame(VECTORS + [(100 + i, [0.0] * 3) for i in range(60)], "vec_id int, embedding array<double>")
    got = {r["g"]: r["mean"] for r in vectors.embed_tokens(counts, table, "g", broadcast_bytes=limit).collect()}
    assert got.keys() == brute().keys()
    for g, mean in brute().items():
        assert got[g] == pytest.approx(mean)


def test_a_group_has_one_row_for_its_sums_where_its_vectors_are_looked_up(spark):
    """A row for each dimension and token went through the shuffle before."""
    pick = random.Random(1)
    counts = spark.createDataFrame([(g, i, 1) for g in range(50) for i in range(40)], "g long, id int, cnt long").repartition(8)
    table = spark.createDataFrame([(i, [pick.random() for _ in range(16)]) for i in range(40)], "vec_id int, embedding array<double>")
    out = vectors.embed_tokens(counts, table, "g")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert out.count() == 50
