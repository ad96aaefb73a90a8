"""Global positions over an ordered table (two-level prefix sums).

A global running total over a data-sized table must not go through one
partition.  We range-partition on the order key (balanced by sampling, a hot
document is split across blocks because the key includes the line number),
take a local running sum inside each sorted block, then add the exclusive
prefix of the per-block totals.  The block table has exactly ``blocks`` rows
(a parameter we pick), so broadcasting it is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package


def default_blocks(df: DataFrame) -> int:
    """As many blocks as the plan reads files, so they grow with the data, and no
    fewer than the session's shuffle partitions.  Nothing runs for it."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(df.inputFiles()))


def range_blocks(df: DataFrame, order_cols: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Range-partition on the order key and sort each block."""
    n = blocks or default_blocks(df)
    return df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)


def _local_sums(size_col: str, local_col: str, group_col: str | None = None):
    """Exclusive running sum inside a sorted block; restarts when ``group_col``
    changes (rows are sorted by the group first)."""
    def run(batches):
        pid = TaskContext.get().partitionId()
        carry, last_group = 0, None
        for b in batches:
            n = len(b)
            sizes = np.asarray(pc.fill_null(b.column(size_col).cast(pa.int64()), 0), np.int64)
            if group_col is None:
                starts = np.zeros(n, bool)
            else:
                g = b.column(group_col).to_numpy(zero_copy_only=False)
                starts = np.empty(n, bool)
                if n:
                    starts[0] = g[0] != last_group
                    starts[1:] = g[1:] != g[:-1]
                    last_group = g[-1]
            raw = sizes.copy()
            if n and not starts[0]:
                raw[0] += carry  # the first rows continue the previous batch's group
            raw = np.cumsum(raw)
            # restart at each group start: remove the raw total reached just before it
            last = np.maximum.accumulate(np.where(starts, np.arange(n), -1)) if n else starts
            inclusive = raw - np.where(last >= 1, raw[np.maximum(last - 1, 0)], 0)
            before = inclusive - sizes
            if n:
                carry = int(inclusive[-1])
            yield (b.append_column("_blk", pa.array(np.full(n, pid, np.int32)))
                    .append_column(local_col, pa.array(before, pa.int64())))
    return run


def exclusive_prefix_sum(df: DataFrame, size_col: str, order_cols: Sequence[str],
                         out_col: str = "start", blocks: int | None = None,
                         checkpoint: bool = True, group_col: str | None = None,
                         transform=None) -> DataFrame:
    """Add ``out_col`` = sum of ``size_col`` over all rows strictly before (in order).

    With ``group_col`` (which must be the first order column) the sum restarts
    for every group value.  Also keeps ``_blk`` (the range block id, ordered
    like the key).  The block-local stage is checkpointed so the block
    assignment is frozen and the upstream work (e.g. encoding) is not
    recomputed for the block totals.

    ``transform`` (a row-local DataFrame → DataFrame step such as encoding) runs
    after the range shuffle, inside the sorted blocks: the range sampler then
    reads only the cheap input instead of evaluating the step an extra time.
    """
    if group_col is not None and order_cols[0] != group_col:
        raise ValueError("group_col must lead the order columns")
    ship_package(df.sparkSession)
    ranged = range_blocks(df, order_cols, blocks)
    if transform is not None:
        ranged = transform(ranged)
    schema = T.StructType(ranged.schema.fields + [
        T.StructField("_blk", T.IntegerType(), False),
        T.StructField("_local", T.LongType(), False)])
    local = ranged.mapInArrow(_local_sums(size_col, "_local", group_col), schema)
    if checkpoint:
        local = cut_lineage(local)
    keys = ["_blk"] + ([group_col] if group_col else [])
    totals = local.groupBy(*keys).agg(F.sum(F.col(size_col).cast("long")).alias("_tot"))
    # One row per (group, block): a window over at most blocks × groups rows.
    w = (Window.partitionBy(group_col) if group_col else Window).orderBy("_blk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, F.coalesce(F.sum("_tot").over(w), F.lit(0)).alias("_base"))
    out = local.join(F.broadcast(base), keys)
    return out.withColumn(out_col, (F.col("_base") + F.col("_local")).cast("long")) \
              .drop("_base", "_local")
