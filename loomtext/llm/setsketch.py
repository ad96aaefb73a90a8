"""Operator 10: near-duplicates over SetSketch registers.

A document's set of word shingles becomes ``REGISTERS`` exponentially spaced
truncated minima (base ``BASE``): register i is ``floor(1 - log_b(least
exponential hash))``, clipped to 16 bits.  Registers of a union are the
maxima, and two sets agree in a register with about their similarity.

Equal sets are one class.  Classes that agree in a band of registers share a
bucket.  Every bucket has a hub, its member in the most and largest buckets;
members are compared with the hub, and a member that does not link to it is
compared with all others of the bucket, in blocks bounded by members and by
shingles.  A
comparison first estimates the similarity from both sketches by likelihood (set
sizes are known) and drops clear strangers, then counts the full sets.  No pairs
of a group are listed: a block returns a spanning forest of its verified links, and
components come from these.

A band is missed by two sets of similarity 0.8 with probability 1 - 0.8^4, all
32 of them with 5e-8; the estimate drops sets of equal size when 71 registers or
fewer of 128 agree, with 3e-10 (binomial), so the total stays 5e-8.

Defined cases: null and empty texts have an empty set and are linked with
nothing; fewer words than a shingle make one; a null key is never a component's
name unless all its keys are null; repeated rows are in one class; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import discard, materialize, text_or_empty
from .components import components
from .text_hash import buffers, shingle_sets, word_hashes

BANDS, ROWS, BASE, RATE, TOP = 32, 4, 1.001, 20.0, (1 << 16) - 1
REGISTERS = BANDS * ROWS
#: Estimates lower than the threshold by this are not counted exactly.
SLACK = 0.24
#: Texts hashed at a time; members of a bucket compared at a time, and their shingles (16 MB a side).
STEP, LEFT, RIGHT, SHINGLES = 128, 256, 1024, 1 << 21
#: Components of a larger share of the linked classes are broadcast (at most 1 / share rows).
HOT_SHARE = 1e-4

_SEEDS = np.random.default_rng(10).integers(1, 1 << 63, (REGISTERS, 2), dtype=np.uint64) | np.uint64(1)


def sketches(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers of each set (rows); an empty set has zeros."""
    n = len(bounds) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    starts = bounds[:-1][full]
    for i, (x, m) in enumerate(_SEEDS):
        h = (sets ^ x) * m
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum.reduceat(h, starts)
        u = (low.astype(np.float64) + 0.5) / 2.0 ** 64
        exponential = -np.log1p(-u) / RATE
        out[full, i] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP)
    return out


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Likeliest similarity of pairs of sketches (rows) whose set sizes are known.

    With shares u and v of the sizes, register a exceeds b with probability
    p(u - vJ) and falls below with p(v - uJ), where p(x) = -log_b(1 - x(b-1)/b).
    The log-likelihood is concave in J; its peak is found by golden sections.
    """
    more = (a > b).sum(axis=-1)
    less = (a < b).sum(axis=-1)
    same = a.shape[-1] - more - less
    u = size_a / np.maximum(size_a + size_b, 1)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return (more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12))
                + same * np.log(np.maximum(1 - up - down, 1e-12)))

    g = (np.sqrt(5) - 1) / 2
    lo, hi = np.zeros_like(u), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    for _ in range(24):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(x) > likelihood(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                sets, bounds = shingle_sets(*word_hashes(*buffers(b.column("text"))), width)
                regs = sketches(sets, bounds)
                yield pa.RecordBatch.from_arrays([
                    b.column("key"), pa.array(np.diff(bounds)),
                    pa.array([_digest(sets[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary())], names=["key", "n", "digest", "regs"])
    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                sets, bounds = shingle_sets(*word_hashes(*buffers(b.column("text"))), width)
                each = [sets[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([_digest(s) for s in each], pa.binary()),
                    pa.array([s.tobytes() for s in each], pa.binary())], names=["digest", "set"])
    return run


def _bands(batches):
    """(class, bucket): one row for each band; the bucket is 128 bits."""
    for b in batches:
        ids = b.column("cid").to_numpy()
        regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16).reshape(len(ids), BANDS, ROWS)
        low = regs.astype(np.int64)
        key = (low[..., 0] << 48) | (low[..., 1] << 32) | (low[..., 2] << 16) | low[..., 3]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(ids, BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(ids))),
            pa.array(key.ravel())], names=["cid", "band", "bucket"])


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def _near(percent: int):
    """Keeps pairs (rows with both sketches) that the estimate does not rule out."""
    def run(batches):
        for b in batches:
            n, m = b.column("n").to_numpy(), b.column("hub_n").to_numpy()
            j = estimate(_registers(b.column("regs").to_pylist()), _registers(b.column("hub_regs").to_pylist()), n, m) \
                if len(n) else np.zeros(0)
            keep = (j >= percent / 100 - SLACK) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield b.select(["cid", "hub"]).filter(pa.array(keep))
    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                keep = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                        for x, y in zip(b.column("set").to_pylist(), b.column("hub_set").to_pylist(), strict=True)]
                yield b.select(["cid", "hub"]).filter(pa.array(keep, pa.bool_()))
    return run


def _block(percent: int):
    """Links between the left rows (not linked to the hub) and the right rows of one block.

    A spanning forest of them: rows that verified links of the block connect already
    are not compared again, so a block has fewer links than rows.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        links = []
        if len(left) and len(right):
            regs, n = _registers(right["regs"]), right["n"].to_numpy()
            ids, stray = right["cid"].to_numpy(), right["stray"].to_numpy()
            nodes = np.unique(np.concatenate([ids, left["cid"].to_numpy()]))
            group, place = np.arange(len(nodes)), np.searchsorted(nodes, ids)
            flat = np.concatenate([np.frombuffer(s, np.uint64) for s in right["set"]])
            names, local = np.unique(flat, return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            for cid, size, reg, own in zip(left["cid"], left["n"], _registers(left["regs"]), left["set"], strict=True):
                # Two members without a link to the hub meet twice; one turn counts.
                mine = group[np.searchsorted(nodes, cid)]
                near = (group[place] != mine) & (~stray | (ids > cid)) \
                    & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
                near = np.flatnonzero(near)
                near = near[estimate(np.broadcast_to(reg, (len(near), REGISTERS)), regs[near],
                                     np.full(len(near), size), n[near]) >= percent / 100 - SLACK]
                if len(near):
                    own = np.frombuffer(own, np.uint64)
                    at = np.searchsorted(names, own)
                    at = at[np.minimum(at, len(names) - 1) == at]
                    held = np.zeros(len(names), bool)
                    held[at[np.isin(names[at], own)]] = True
                    both = np.add.reduceat(held[local].astype(np.int64), starts)[near]
                    near = near[100 * both >= percent * (size + n[near] - both)]
                    theirs, first = np.unique(group[place[near]], return_index=True)
                    links += [(cid, x) for x in ids[near[first]]]
                    group[np.isin(group, theirs)] = mine
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    return run


def near_links(docs: DataFrame, key: str, text: str, width: int, percent: int):
    """(rows (key, n, digest), classes (cid, digest, n, least), verified links (a, b) of classes,
    tables that only the links read)."""
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    rows = materialize(d.mapInArrow(_sketch(width), "key long, n long, digest binary, regs binary"), "sketches")
    classes = materialize(rows.groupBy("digest").agg(
        F.min("key").alias("least"), F.min("n").alias("n"), F.min("regs").alias("regs"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    bands = classes.where("n > 0").select("cid", "regs").mapInArrow(
        _bands, "cid long, band int, bucket long")
    shared = bands.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(bands.join(shared, ["band", "bucket"]), "members")
    rank = members.groupBy("cid").agg(F.sum("size").alias("rank"))
    hubs = members.join(rank, "cid").groupBy("band", "bucket").agg(F.max_by("cid", "rank").alias("hub"))
    in_bucket = materialize(members.join(hubs, ["band", "bucket"]), "buckets")
    discard(members)

    sketch = classes.select("cid", "n", "regs")
    hub_sketch = sketch.select(*(F.col(c).alias("hub" if c == "cid" else f"hub_{c}") for c in sketch.columns))
    pairs = in_bucket.where("cid <> hub").select("cid", "hub").distinct()
    close = materialize(pairs.join(sketch, "cid").join(hub_sketch, "hub")
                        .select("cid", "hub", "n", "regs", "hub_n", "hub_regs")
                        .mapInArrow(_near(percent), "cid long, hub long"), "close")
    # The sets of the classes that any comparison may need, from one whole text each.
    open_buckets = in_bucket.where("size > 2")
    needed = close.select("cid").unionByName(close.select(F.col("hub").alias("cid"))) \
        .unionByName(open_buckets.select("cid")).distinct()
    wanted = classes.join(needed, "cid").select("cid", "digest", F.col("least").alias("key"))
    name = F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit(""))
    texts = d.withColumn("name", name).join(wanted.select(name.alias("name")).distinct(), "name", "left_semi")
    found = texts.select("text").mapInArrow(_sets(width), "digest binary, set binary")
    sets = materialize(found.join(wanted.select("cid", "digest"), "digest")
                       .select("cid", "set").dropDuplicates(["cid"]), "sets")

    both = close.join(sets, "cid").join(sets.select(F.col("cid").alias("hub"), F.col("set").alias("hub_set")), "hub")
    links = materialize(both.select("cid", "hub", "set", "hub_set")
                        .mapInArrow(_confirm(percent), "cid long, hub long"), "hub-links")
    linked = open_buckets.join(links.withColumn("linked", F.lit(True)), ["cid", "hub"], "left").select(
        "band", "bucket", "size", "cid", (F.col("linked").isNull() & (F.col("cid") != F.col("hub"))).alias("stray"))
    linked = linked.join(classes.select("cid", "n"), "cid")
    stray = F.col("stray").cast("long")
    strays = linked.groupBy("band", "bucket").agg(
        F.sum(stray).alias("strays"), F.sum(stray * F.col("n")).alias("left_n"), F.sum("n").alias("right_n")) \
        .where("strays > 0")
    # A stray meets every block of members, a member every block of strays.
    rest = linked.drop("n").join(strays, ["band", "bucket"]) \
        .withColumn("lefts", F.ceil(F.greatest(F.col("strays") / LEFT, F.col("left_n") / SHINGLES))) \
        .withColumn("rights", F.ceil(F.greatest(F.col("size") / RIGHT, F.col("right_n") / SHINGLES)))
    at = F.xxhash64("cid")
    sides = rest.where("stray").select(
        "band", "bucket", "cid", "stray", F.lit(0).alias("side"), F.pmod(at, F.col("lefts")).alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j")).unionByName(rest.select(
            "band", "bucket", "cid", "stray", F.lit(1).alias("side"),
            F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), F.pmod(at, F.col("rights")).alias("j")))
    more = sides.join(sketch, "cid").join(sets, "cid").groupBy("band", "bucket", "i", "j") \
        .applyInPandas(_block(percent), "a long, b long")
    all_links = links.select(F.col("cid").alias("a"), F.col("hub").alias("b")).unionByName(more)
    return (rows.select("key", "n", "digest"), classes.select("cid", "digest", "n", "least"), all_links,
            [in_bucket, close, sets, links])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per document: key, n_shingles, component_id, kept."""
    rows, classes, links, used = near_links(docs, key, text, width, percent)
    roots = components(links)
    for table in used:
        discard(table)
    named = materialize(classes.where("n > 0").join(roots, F.col("cid") == F.col("node"), "left")
                        .select("digest", "least", "root"), "rooted")
    alone, linked = named.where("root is null"), named.where("root is not null")
    groups = materialize(linked.groupBy("root").agg(
        F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "groups")
    large = F.col("size") > HOT_SHARE * (groups.agg(F.sum("size")).first()[0] or 0)
    hot = F.broadcast(groups.where(large).drop("size"))
    told = linked.join(hot, "root").unionByName(
        linked.join(hot, "root", "left_anti").join(groups.where(~large).drop("size"), "root"))
    by_class = materialize(alone.select("digest", F.col("least").alias("component_id"))
                           .unionByName(told.select("digest", "component_id")), "components")
    empty = F.col("n") == 0
    out = rows.where(~empty).join(by_class, "digest").select("key", "n", "component_id") \
        .unionByName(rows.where(empty).select("key", "n", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id",
                      F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
