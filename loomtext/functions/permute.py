"""A seeded permutation of 0..n-1 as a column expression: a shuffle without a sort.

Numbers below a*b, the least rectangle of about square sides that holds n, are written
as (l, r) and go through Feistel rounds: one half is shifted by a hash of the other, so
each round can be undone.  A result beyond n goes through the rounds again (cycle
walking), which keeps the map a permutation of 0..n-1; fewer than a numbers lie beyond.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: Walks tried; a number needs k more walks with probability a**-k.
WALKS = 40


def sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(0, n - 1)) + 1
    return a, -(-n // a) if n else 1


def _hash(seed: int, epoch: Column, rnd: int, half: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.lit(str(rnd)), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _round(a: int, b: int, seed: int, epoch: Column, k: int):
    if k % 2 == 0:
        return lambda h: F.struct(((h["l"] + _hash(seed, epoch, k, h["r"])) % a).alias("l"), h["r"].alias("r"))
    return lambda h: F.struct(h["l"].alias("l"), ((h["r"] + _hash(seed, epoch, k, h["l"])) % b).alias("r"))


def _rounds(x: Column, a: int, b: int, seed: int, epoch: Column) -> Column:
    halves = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
    for k in range(ROUNDS):
        # a one-element transform names the halves, so none is computed twice
        halves = F.transform(F.array(halves), _round(a, b, seed, epoch, k))[0]
    return F.transform(F.array(halves), lambda h: h["l"] * b + h["r"])[0]


def permuted(index: Column, n: int, seed: int, epoch: Column) -> Column:
    """Where ``index`` (0..n-1) goes in the permutation of this seed and epoch."""
    a, b = sides(n)
    walks = min(WALKS, a * b - n)
    index, epoch = index.cast("long"), epoch.cast("long")
    out = F.aggregate(F.array_repeat(F.lit(0), walks), _rounds(index, a, b, seed, epoch),
                      lambda x, _: F.when(x >= n, _rounds(x, a, b, seed, epoch)).otherwise(x)) \
        if walks else _rounds(index, a, b, seed, epoch)
    return F.transform(F.array(out), lambda x: F.when(x < n, x).otherwise(
        F.raise_error(F.lit("permutation: too many walks")).cast("long")))[0]


def rounds_sql(x: str, a: str, b: str, seed: int, epoch: str, source: str, keep: str) -> str:
    """DuckDB: ``SELECT keep, x_`` of one pass through the rounds over ``source``."""
    sql = f"SELECT {keep}, {x} // {b} AS l_, {x} % {b} AS r_ FROM {source}"
    for k in range(ROUNDS):
        half, other, side = ("l_", "r_", a) if k % 2 == 0 else ("r_", "l_", b)
        shift = f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {epoch}, '{k}', {other})), 1, 13) AS BIGINT)"
        sql = f"SELECT * REPLACE (({half} + {shift}) % {side} AS {half}) FROM ({sql})"
    return f"SELECT {keep}, l_ * {b} + r_ AS x_ FROM ({sql})"
