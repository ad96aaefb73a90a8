"""From ``documents`` to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.  A stage drops rows by a row id of its own, so
rows that share a doc_id, or have none, stay or go each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.chunk_dedup import drop_exact_copies
from loomtext.llm.common import materialize, read_table
from loomtext.llm.decontam import contamination
from loomtext.llm.hilbert_pack import pack
from loomtext.llm.quality_mil import keep_good
from loomtext.llm.setsketch import near_duplicates


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """With a row id, frozen by writing, and the id's name, which the input lacks."""
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), f"rows-{name}"), row


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of a group linked by similarity 0.8 over five words, the row with the
    least doc_id stays (null ids last; of equal ids the first row)."""
    rows, row = _numbered(docs, "near")
    groups = near_duplicates(rows.select(row, "text"), key=row, width=5).select(F.col(row).alias("r"), "component_id")
    ids = rows.select(F.col(row).alias("r"), F.col("doc_id").alias("i"))
    stays = groups.join(ids, "r").groupBy("component_id") \
        .agg(F.min(F.struct(F.col("i").isNull(), "i", "r"))["r"].alias(row))
    return rows.join(stays.select(row), row, "left_semi").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark window go."""
    rows, row = _numbered(docs, "benchmark")
    found = contamination(rows.select(row, "text"), read_table(spark, sf_dir, "benchmark"), key=row) \
        .where("contaminated")
    return rows.join(found.select(row), row, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: what stays, packed along the curve."""
    return pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("decontamination", benchmark_stage), ("packing", packing_stage)]

#: The classifier and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
