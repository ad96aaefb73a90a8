"""Sequence packing: splits, shards, windows, (x, y), batch plan.

Tables
------
encoded : (split, *order, ids array<int>)         one row per non-empty line
shards  : (split, shard_id, *order, pos long, ids) pos = offset inside the shard
windows : (split, window_id long, ids array<int>)
batch   : (step long, micro int, slot int, window_id long, lr double)

Order-dependent work uses range partitions ("blocks") of the order key and
per-block running sums (``positions``); nothing goes through a single task.

Exact sharding (T8) closes a shard at the first whole line where the buffered
tokens reach S.  With cumulative line ends c, the boundaries are
``b_{k+1} = min{c_i : c_i >= b_k + S}``: a chain that depends on where it
enters each block.  The token stream is cut into blocks of a fixed number of
tokens; a chain can enter a block only in its first S tokens, so a block is a
short step function from entry to exit, tabulated in parallel.  The functions
are composed FAN blocks at a time up a tree, and the true entries are handed down
it: 2 log_FAN(blocks) small jobs, the same path at every size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.permute import permuted
from ..functions.schedule import cosine_warmup
from ..session import cut_lineage, ship_package
from .positions import exclusive_prefix_sum


# ---------------------------------------------------------------------------
# offsets
# ---------------------------------------------------------------------------
def token_offsets(encoded: DataFrame, order_cols: Sequence[str], ids_col: str | None = "ids",
                  split_col: str = "split", blocks: int | None = None,
                  encode=None) -> DataFrame:
    """Add ``n`` (tokens), ``start`` (tokens before the line inside its split)
    and ``_blk``.  Zero-token lines are dropped first (B5).  With ``ids_col=None`` the
    rows bring ``n`` themselves, where only lengths are needed.

    With ``encode`` (a row-local step producing ``ids_col``), ``encoded`` holds
    the raw lines and the step runs after the range shuffle, so the range
    sampler does not evaluate it a second time.
    """
    def sized(df: DataFrame) -> DataFrame:
        if encode is not None:
            df = encode(df)
        n = F.size(ids_col) if ids_col else F.col("n")
        return df.withColumn("n", n.cast("long")).where(F.col("n") > 0)

    keyed = [split_col, *order_cols]
    # the running total restarts for every split (split leads the order key)
    if encode is None:
        return exclusive_prefix_sum(sized(encoded), "n", keyed, out_col="start", blocks=blocks,
                                    group_col=split_col)
    return exclusive_prefix_sum(encoded, "n", keyed, out_col="start", blocks=blocks,
                                group_col=split_col, transform=sized)


# ---------------------------------------------------------------------------
# shards
# ---------------------------------------------------------------------------
def shards_fast(offsets: DataFrame, shard_tokens: int) -> DataFrame:
    """E5 fast mode: shard = floor(start / S) — parallel, not the T8 rule."""
    return offsets.withColumn("shard_id", F.floor(F.col("start") / F.lit(shard_tokens))
                              .cast("int"))


#: Tokens of a block in shards: a block has at most BLOCK_SHARDS + 1 boundaries.
BLOCK_SHARDS = 8
#: Blocks composed in one task, level by level.
FAN = 16

_STEP = "{split} string, blk long, c long, exit long, cnt long, last long"
_ENTRY = "{split} string, blk long, t long, prior long, prev long"


def _block_function(S: int, width: int, split_col: str):
    """A block's step function from its sorted line ends.

    A row (c, exit, cnt, last): entering with a threshold above the previous
    row's c and up to this c leaves with ``exit`` after ``cnt`` boundaries, the
    last at ``last``.  The block's own end closes the list: a threshold that no
    line end of the block reaches passes through to the next block.
    """
    def run(pdf):
        import pandas as pd
        blk, split = int(pdf["blk"].iloc[0]), pdf[split_col].iloc[0]
        ends = np.sort(pdf["_end"].to_numpy())
        stop = (blk + 1) * width
        k = min(int(np.searchsorted(ends, blk * width + S)) + 1, len(ends))
        c = ends[:k]
        last, cnt, live = c.copy(), np.ones(k, np.int64), np.arange(k)
        while len(live):
            j = np.searchsorted(ends, last[live] + S)
            inside = j < len(ends)
            live = live[inside]
            last[live] = ends[j[inside]]
            cnt[live] += 1
        return pd.DataFrame({split_col: split, "blk": blk, "c": np.append(c, stop),
                             "exit": np.append(np.maximum(last + S, stop), stop),
                             "cnt": np.append(cnt, 0), "last": np.append(last, -1)})
    return run


def _apply(rows, t: np.ndarray, stop: int):
    """(exit, cnt, last) of thresholds t; a block without rows passes them on."""
    if rows is None:
        return np.full(len(t), stop), np.zeros(len(t), np.int64), np.full(len(t), -1)
    i = np.searchsorted(rows["c"], t)
    return rows["exit"][i], rows["cnt"][i], rows["last"][i]


def _children(pdf) -> dict:
    return {int(b): {k: g[k].to_numpy() for k in ("c", "exit", "cnt", "last")}
            for b, g in pdf.sort_values(["blk", "c"]).groupby("blk")}


def _compose(width: int, split_col: str):
    """The step function of FAN neighbouring blocks of ``width`` tokens."""
    def run(pdf):
        import pandas as pd
        split, up = pdf[split_col].iloc[0], int(pdf["blk"].iloc[0]) // FAN
        kids, first = _children(pdf), up * FAN
        t = kids[first]["c"] if first in kids else np.array([(first + 1) * width])
        c, cnt, last = t, np.zeros(len(t), np.int64), np.full(len(t), -1)
        for b in range(first, first + FAN):
            t, n, seen = _apply(kids.get(b), t, (b + 1) * width)
            cnt, last = cnt + n, np.where(seen >= 0, seen, last)
        return pd.DataFrame({split_col: split, "blk": up, "c": c, "exit": t, "cnt": cnt, "last": last})
    return run


def _descend(width: int, split_col: str):
    """A group's entry becomes an entry for each block in it that has rows."""
    def run(kids_pdf, entry_pdf):
        import pandas as pd
        if not len(kids_pdf) or not len(entry_pdf):
            return pd.DataFrame({split_col: pd.Series([], dtype=str), **{
                k: pd.Series([], dtype="int64") for k in ("blk", "t", "prior", "prev")}})
        e = entry_pdf.iloc[0]
        t, prior, prev = np.array([e["t"]]), int(e["prior"]), int(e["prev"])
        kids, first, out = _children(kids_pdf), int(e["blk"]) * FAN, []
        for b in range(first, first + FAN):
            if b in kids:
                out.append((kids_pdf[split_col].iloc[0], b, int(t[0]), prior, prev))
            t, n, seen = _apply(kids.get(b), t, (b + 1) * width)
            prior += int(n[0])
            prev = int(seen[0]) if seen[0] >= 0 else prev
        return pd.DataFrame(out, columns=[split_col, "blk", "t", "prior", "prev"])
    return run


def _block_bounds(S: int, split_col: str):
    """A block's boundaries from its entry: at most BLOCK_SHARDS + 1."""
    def run(ends_pdf, entry_pdf):
        import pandas as pd
        if not len(ends_pdf) or not len(entry_pdf):
            return pd.DataFrame({split_col: pd.Series([], dtype=str), "blk": pd.Series([], dtype="int64"),
                                 "prior": pd.Series([], dtype="int64"), "bounds": pd.Series([], dtype=object)})
        e = entry_pdf.iloc[0]
        ends, t, bounds = np.sort(ends_pdf["_end"].to_numpy()), int(e["t"]), [int(e["prev"])]
        while (j := int(np.searchsorted(ends, t))) < len(ends):
            bounds.append(int(ends[j]))
            t = bounds[-1] + S
        return pd.DataFrame({split_col: [e[split_col]], "blk": [int(e["blk"])], "prior": [int(e["prior"])],
                             "bounds": [bounds]})
    return run


def shards_exact(offsets: DataFrame, shard_tokens: int, split_col: str = "split") -> DataFrame:
    """E5 exact mode (T8): shard ids equal to a sequential buffered pass.

    ``offsets`` comes from ``token_offsets``.  Adds ``shard_id`` and ``pos``
    (tokens before the line in its shard).  One path at every size: blocks of
    BLOCK_SHARDS x S tokens, their step functions composed FAN at a time up a
    tree, entries handed down the same tree, boundaries numbered in the blocks.
    """
    S = int(shard_tokens)
    width = BLOCK_SHARDS * S
    ship_package(offsets.sparkSession)
    end = F.col("start") + F.col("n")
    ends = offsets.select(split_col, F.floor((end - 1) / F.lit(width)).cast("long").alias("blk"),
                          end.alias("_end"))
    step, entry = _STEP.format(split=split_col), _ENTRY.format(split=split_col)
    levels = [cut_lineage(ends.groupBy(split_col, "blk").applyInPandas(
        _block_function(S, width, split_col), step))]
    widths = [width]
    while (levels[-1].agg(F.max("blk")).first()[0] or 0) > 0:
        w = widths[-1]
        levels.append(cut_lineage(levels[-1].groupBy(split_col, F.floor(F.col("blk") / FAN).alias("_up"))
                                  .applyInPandas(_compose(w, split_col), step)))
        widths.append(w * FAN)
    entries = levels[-1].select(split_col, "blk").distinct().select(
        split_col, "blk", F.lit(S).cast("long").alias("t"), F.lit(0).cast("long").alias("prior"),
        F.lit(0).cast("long").alias("prev"))
    for level, w in zip(levels[-2::-1], widths[-2::-1]):
        up = F.floor(F.col("blk") / FAN)
        entries = level.withColumn("_up", up).groupBy(split_col, "_up").cogroup(
            entries.withColumn("_up", F.col("blk")).groupBy(split_col, "_up")) \
            .applyInPandas(_descend(w, split_col), entry)
    bounds = ends.groupBy(split_col, "blk").cogroup(entries.groupBy(split_col, "blk")).applyInPandas(
        _block_bounds(S, split_col), f"{split_col} string, blk long, prior long, bounds array<long>")
    keyed = offsets.withColumn("blk", F.floor((end - 1) / F.lit(width)).cast("long"))
    local = F.size(F.filter("bounds", lambda b: b < end)) - 1  # bounds[0] is the last one before the block
    local = F.greatest(local, F.lit(0))
    return keyed.join(bounds, [split_col, "blk"]) \
        .withColumn("shard_id", (F.col("prior") + local).cast("int")) \
        .withColumn("pos", F.col("start") - F.element_at("bounds", (local + 1).cast("int"))) \
        .drop("bounds", "prior", "blk")


def shard_positions(sharded: DataFrame, split_col: str = "split") -> DataFrame:
    """``pos`` = token offset of the line inside its shard, where it is not there yet."""
    if "pos" in sharded.columns:
        return sharded
    first = sharded.groupBy(split_col, "shard_id").agg(F.min("start").alias("_s0"))
    return sharded.join(first, [split_col, "shard_id"]) \
                  .withColumn("pos", F.col("start") - F.col("_s0")).drop("_s0")


def shard_totals(sharded: DataFrame, split_col: str = "split") -> DataFrame:
    """D3 + H12: per shard name, token and line count."""
    from ..functions.text import shard_name
    return sharded.groupBy(split_col, "shard_id").agg(
        F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_lines")) \
        .withColumn("name", shard_name(split_col, "shard_id"))


#: Shards whose files share a folder.
SHARD_GROUP = 64


def write_shards(sharded: DataFrame, path: str, order_cols: Sequence[str],
                 split_col: str = "split", one_dir_per_shard: bool = False) -> None:
    """A4: token-shard sink.

    Folders hold one split and ``SHARD_GROUP`` neighbouring shards; files in them hold
    contiguous shard ranges sorted by (shard_id, order).  So a reader of listed shards
    opens only their folders, without one folder per shard (millions at scale).
    ``one_dir_per_shard`` mirrors the one-file-per-shard layout.
    """
    cols = [split_col, "shard_id", *order_cols, "pos", "ids"]
    data = sharded.select(*cols, F.floor(F.col("shard_id") / SHARD_GROUP).cast("int").alias("shard_group"))
    if one_dir_per_shard:
        data.drop("shard_group").repartition(split_col, "shard_id").write.mode("overwrite") \
            .partitionBy(split_col, "shard_id").parquet(path)
    else:
        data.repartitionByRange(split_col, "shard_id").sortWithinPartitions(
            split_col, "shard_id", *order_cols).write.mode("overwrite").partitionBy(split_col, "shard_group") \
            .parquet(path)


def read_shards(spark, path: str, split: str | None = None, split_col: str = "split",
                shards: Sequence[int] | range | None = None) -> DataFrame:
    """A5: shard scan.  A split, and a list or range of shard ids, prune the files opened.

    A range becomes bounds, a list a membership test, on the folders' shard group and on
    the shard itself (row-group statistics skip the rest).  Unknown ids give no rows.
    """
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col(split_col) == split)
    grouped = "shard_group" in df.columns
    if isinstance(shards, range) and shards.step == 1:
        df = df.where(F.col("shard_id").between(shards.start, shards.stop - 1))
        if grouped:
            df = df.where(F.col("shard_group").between(shards.start // SHARD_GROUP, (shards.stop - 1) // SHARD_GROUP))
    elif shards is not None:
        listed = sorted({int(s) for s in shards})
        df = df.where(F.col("shard_id").isin(listed))
        if grouped:
            df = df.where(F.col("shard_group").isin(sorted({s // SHARD_GROUP for s in listed})))
    return df.drop("shard_group")


# ---------------------------------------------------------------------------
# windows
# ---------------------------------------------------------------------------
def windows(offsets: DataFrame, length: int, stride: int | None = None, drop_tail: bool = True,
            per_shard: bool = False, split_col: str = "split") -> DataFrame:
    """Fixed-length windows over the token stream of each split.

    Window k covers stream positions [k·stride, k·stride + length).  Each line
    is cut into the fragments that fall in each window it touches (so rows ≈
    lines, not tokens), then fragments are regrouped by window and ordered by
    their offset.  A window group holds at most ``length`` tokens.  With
    ``per_shard`` the stream restarts at each shard (needs ``shard_id`` and
    ``pos``).
    """
    L, st = int(length), int(stride or length)
    s = F.col("pos") if per_shard else F.col("start")
    e = s + F.col("n")
    k0 = F.greatest(F.lit(0), F.ceil((s - F.lit(L) + 1) / F.lit(st))).cast("long")
    k1 = F.floor((e - 1) / F.lit(st)).cast("long")
    keys = [split_col] + (["shard_id"] if per_shard else [])

    def fragment(k):
        lo = F.greatest(F.col("_s"), k * st)
        hi = F.least(F.col("_s") + F.size("ids"), k * st + L)
        return F.struct(k.alias("k"), lo.alias("_lo"), F.slice(
            "ids", (lo - F.col("_s") + 1).cast("int"), (hi - lo).cast("int")).alias("_frag"))

    # sliced before the explode: no row carries more than its own fragment
    frag = offsets.select(*keys, s.alias("_s"), "ids", k0.alias("_k0"), F.greatest(k0, k1).alias("_k1")) \
        .select(*keys, F.inline(F.transform(F.sequence("_k0", "_k1"), fragment)))
    grouped = frag.groupBy(*keys, "k").agg(
        F.array_sort(F.collect_list(F.struct("_lo", "_frag"))).alias("_parts"))
    out = grouped.select(*keys, F.col("k").alias("window_id"),
                         F.flatten(F.transform("_parts", lambda p: p["_frag"])).alias("ids"))
    if drop_tail:
        out = out.where(F.size("ids") == L)
    return out


def xy(windows_df: DataFrame, ids_col: str = "ids", mask_negative: bool = True) -> DataFrame:
    """x = w[:-1], y = w[1:] (shift exactly once); labels whose input
    is negative become NULL (ignored by averages)."""
    n = F.size(ids_col)
    x = F.slice(ids_col, 1, n - 1)
    y = F.slice(ids_col, 2, n - 1)
    if mask_negative:
        y = F.zip_with(x, y, lambda a, b: F.when(a >= 0, b))
    return windows_df.withColumn("x", x).withColumn("y", y)


# ---------------------------------------------------------------------------
# batch plan
# ---------------------------------------------------------------------------
def dense_window_index(windows_df: DataFrame, order_cols: Sequence[str], seed: int | None = None,
                       blocks: int | None = None) -> DataFrame:
    """Dense 0..W-1 index over windows in order (or in seeded hash order)."""
    df = windows_df
    if seed is not None:
        df = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in order_cols]))
        keys = ["_h", *order_cols]
    else:
        keys = list(order_cols)
    one = df.withColumn("_one", F.lit(1).cast("long"))
    idx = exclusive_prefix_sum(one, "_one", keys, out_col="idx", blocks=blocks)
    return idx.drop("_one", "_blk", *(["_h"] if seed is not None else []))


def window_count(n_tokens: int, length: int, stride: int | None = None) -> int:
    """How many full windows a stream of so many tokens holds."""
    return max(0, (int(n_tokens) - int(length)) // int(stride or length) + 1) if n_tokens >= length else 0


def steps_of(n_windows: int, batch_size: int, grad_accum: int, epochs: float) -> int:
    """Optimizer steps that draw every window ``epochs`` times."""
    return math.ceil(epochs * n_windows / (batch_size * grad_accum))


def batch_plan(indexed: DataFrame | None, batch_size: int, grad_accum: int, max_steps: int,
               warmup: int, base_lr: float, start_step: int = 0, n_windows: int | None = None,
               spark=None, seed: int | None = None) -> DataFrame:
    """Draws d = 0.. of an endless loader over W windows.

    draw d → step = start + d // (B·A), micro = (d // B) % A, slot = d % B,
    window = index d mod W; each row carries the step's learning rate.  Windows
    in their own order are numbered densely already: then ``n_windows`` (a count
    of tokens) replaces ``indexed`` (idx, window_id) and no window is built.  With
    ``seed`` every epoch d // W draws all windows once, in an order of its own
    (a permutation computed per row: nothing is sorted or joined).
    """
    spark = spark or indexed.sparkSession
    W = indexed.count() if n_windows is None else int(n_windows)  # one scalar
    if W == 0:
        return spark.createDataFrame([], "step long, micro int, slot int, window_id long, lr double")
    B, A = int(batch_size), int(grad_accum)
    first, last = int(start_step) * B * A, max(int(start_step), int(max_steps)) * B * A
    d = F.col("id")
    # a restart at a later step goes on in the same epoch; without a seed it starts over
    at = d if seed is not None else d - first
    index = F.pmod(at, F.lit(W))
    draws = spark.range(first, last).select(
        F.floor(d / (B * A)).cast("long").alias("step"),
        (F.floor(d / B) % A).cast("int").alias("micro"),
        (d % B).cast("int").alias("slot"),
        (index if seed is None else permuted(index, W, seed, F.floor(d / W))).alias("idx"))
    plan = draws.withColumnRenamed("idx", "window_id") if indexed is None \
        else draws.join(indexed.select("idx", "window_id"), "idx")
    return plan.select("step", "micro", "slot", "window_id",
                       cosine_warmup(F.col("step"), warmup, max_steps, base_lr).alias("lr"))
