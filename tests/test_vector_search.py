"""Exact search by blocks against plain Python."""

import random

import pytest

from loomtext.operators import vector_search as S


def brute(vectors, queries, k):
    out = []
    for q, a in dict((q, a) for q, a in queries if q is not None and a is not None).items():
        scored = []
        for i, b in vectors:
            if i is None or b is None or len(a) != len(b) or None in a or None in b:
                continue
            scored.append((-round(sum(x * y for x, y in zip(a, b)), 9), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket,chunk,block", [(1000, 1000, 4096), (20, 3, 4096), (7, 50, 4096)])
def test_search_equals_brute(spark, bucket, chunk, block):
    pick = random.Random(bucket)
    vectors = [(i, [float(pick.randrange(-3, 4)) for _ in range(4)]) for i in range(150)]
    vectors += [(7, vectors[7][1])] * 2 + [(None, [1.0] * 4), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0, 0.0])]
    queries = vectors[::10] + [(901, [1.0, 2.0]), (5000, [0.0] * 4), (5001, None)]
    schema = "vec_id long, embedding array<double>"
    got = S.search(spark.createDataFrame(vectors, schema).repartition(3), spark.createDataFrame(queries, schema), 5,
                   bucket_rows=bucket, chunk_rows=chunk).collect()
    assert sorted((r.query, r.id, r.score, r["rank"]) for r in got) == brute(vectors, queries, 5)


def test_bound_between_blocks(spark):
    """More vectors than one block holds, in one bucket."""
    df = spark.range(10_000).selectExpr("id AS vec_id", "array(cast(id % 977 as double), 1D) AS embedding")
    got = S.search(df, spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>"), 12).collect()
    want = sorted(((-(i % 977), i) for i in range(10_000)))[:12]
    assert sorted((r["rank"], r.id) for r in got) == [(n + 1, i) for n, (_, i) in enumerate(want)]


def test_empty_sides(spark):
    schema = "vec_id long, embedding array<double>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0])], schema)
    assert S.search(none, one, 3).count() == 0 and S.search(one, none, 3).count() == 0
