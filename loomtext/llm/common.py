"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, whole; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back.

    Cuts lineage with a table every executor can reach, freezes row ids, and
    drops any partitioning the plan knew of (a later join deals both sides anew,
    so adaptive execution can split a hot key).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete tables of ``materialize`` (one, or a union of some) that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs now.  It does so once the driver
    has collected the plans that own them, which may be hours after the last reader."""
    gc.collect()
    spark._jvm.System.gc()


def set_aside(df: DataFrame) -> DataFrame:
    """The same rows with columns named by place (``_in0``, ``_in1``, ...), so that no
    column an operator adds can meet one of the input's, whatever that is called."""
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))])


def aside(df: DataFrame, name: str) -> str:
    """What ``set_aside`` calls a column."""
    return f"_in{df.columns.index(name)}"


def as_given(out: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``df`` again, by their own names."""
    return out.select([f"_in{i}" for i in range(len(df.columns))]).toDF(*df.columns)


def text_or_empty(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that on pure ASCII text, faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, LOWER))


def range_parts(df: DataFrame) -> int:
    """Partitions for a range sort: as many as the scan has splits, so they grow
    with the input, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
               df.rdd.getNumPartitions())
