"""Scans and sinks.

Parquet tables are read with explicit column lists so the scan's ReadSchema
only carries what the plan needs; text files keep a stable order key from
scan metadata instead of relying on partition order.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import drop_invalid_utf8
from ..session import parallelism

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None, balance: bool = True) -> DataFrame:
    """A1: scan one named table (parquet) with column pruning.

    A small table (at most ``spark.sql.files.maxPartitionBytes``) may lie in one row
    group, whatever the number of splits, and one task would run its whole first stage.
    With ``balance`` such a table is dealt round-robin; a larger one is never shuffled.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    small = balance and _scan_bytes(df) <= _split_bytes(spark)
    if columns:
        df = df.select(*columns)
    return df.repartition(parallelism(spark)) if small else df


def _scan_bytes(df: DataFrame) -> float:
    """Bytes of the scanned files, from the plan (unknown on a remote session: infinite)."""
    try:
        return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    except AttributeError:
        return float("inf")


def _split_bytes(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def read_text_lines(spark: SparkSession, paths: Sequence[str] | str,
                    drop_invalid: bool = True) -> DataFrame:
    """A2 + G2: text files as lines, in listed file order.

    Output ``(file_ord int, file string, block long, row long, line string)``;
    order by (file_ord, file, block, row) reproduces the concatenated reading order.  Splits
    of one file are ordered by their byte offset (``_metadata.file_block_start``)
    and rows inside a split by ``monotonically_increasing_id``.  Malformed
    UTF-8 bytes are dropped (``drop_invalid``) as a lenient text reader would.
    """
    if isinstance(paths, str):
        paths = [paths]
    line = drop_invalid_utf8("value") if drop_invalid else F.col("value")
    parts = [
        spark.read.text(p).select(
            F.lit(i).alias("file_ord"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            line.alias("line"))
        for i, p in enumerate(paths)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_text(df: DataFrame, path: str, col: str = "text", mode: str = "overwrite") -> None:
    """A3: text sink, one value per line."""
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def write_text_counted(df: DataFrame, path: str, sources: Sequence[str], col: str = "text",
                       source_col: str = "source", mode: str = "overwrite") -> dict[str, tuple[int, int]]:
    """A3 + D4: the text sink, and (rows, UTF-8 bytes) written of each named source.

    The counters are observed by the writing job itself; the rows are not read again.
    Rows of no named source are written and counted under the key ``None``.
    """
    size = F.octet_length(F.col(col).cast("string")).cast("long")
    named = F.col(source_col).isin(list(sources))
    which = [(f"s{i}", F.col(source_col) == s) for i, s in enumerate(sources)] + \
        [("rest", ~F.coalesce(named, F.lit(False)))]
    metrics = []
    for name, cond in which:
        metrics += [F.count(F.when(cond, 1)).alias(f"{name}_rows"),
                    F.coalesce(F.sum(F.when(cond, size)), F.lit(0)).alias(f"{name}_bytes")]
    seen = Observation()
    write_text(df.observe(seen, *metrics), path, col, mode)
    got = seen.get
    return {s: (got[f"{n}_rows"], got[f"{n}_bytes"]) for s, (n, _) in zip([*sources, None], which)}
