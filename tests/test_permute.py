"""The seeded permutation: every window once an epoch, at every size."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions.permute import permuted, sides
from loomtext.operators import pack


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 10_007])
def test_every_index_once(spark, n):
    a, b = sides(n)
    assert a * b >= n and a * b - n < a
    rows = spark.range(2 * n).select(
        permuted(F.col("id") % n, n, 7, F.floor(F.col("id") / n)).alias("p"), F.floor(F.col("id") / n).alias("e"))
    got = {}
    for r in rows.collect():
        got.setdefault(r.e, []).append(r.p)
    assert all(sorted(v) == list(range(n)) for v in got.values())
    if n > 90:
        assert got[0] != got[1] and got[0] != sorted(got[0])


def test_seed_changes_the_order(spark):
    def order(seed):
        return [r[0] for r in spark.range(100).orderBy("id").select(permuted(F.col("id"), 100, seed, F.lit(0))).collect()]
    assert order(1) != order(2) and order(1) == order(1)


def test_shuffled_plan_draws_each_window_once_an_epoch(spark):
    steps = pack.steps_of(50, 4, 2, 2.0)
    assert steps == 13
    plan = pack.batch_plan(None, 4, 2, steps, 2, 1e-3, n_windows=50, spark=spark, seed=3)
    rows = sorted((r.step * 8 + r.micro * 4 + r.slot, r.window_id) for r in plan.collect())
    drawn = [w for _, w in rows]
    assert len(drawn) == 104 and sorted(drawn[:50]) == sorted(drawn[50:100]) == list(range(50))
    rest = pack.batch_plan(None, 4, 2, steps, 2, 1e-3, start_step=5, n_windows=50, spark=spark, seed=3)
    assert sorted(r.window_id for r in rest.collect()) == sorted(drawn[40:])
