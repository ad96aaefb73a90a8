"""Corpus assembly and line handling.

Tables
------
corpus : (src_ord int, source string, doc_id long, part long, text string)
lines  : (<order cols>, line_no int, line string)

Order is data: every table carries explicit order columns so that later
order-dependent operators (tie-breaks, shards, windows) are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import flatten_newlines, normalize, strip_trailing_newlines
from .positions import exclusive_prefix_sum

DOC_ORDER = ["doc_id"]
LINE_ORDER = ["doc_id", "line_no"]
CORPUS_ORDER = ["src_ord", "doc_id", "part"]
# Fixed value: the whitespace class collapsed by the cleaner (ASCII, incl. VT).
WHITESPACE = r"[\t\n\x0B\f\r ]+"


def documents_corpus(documents: DataFrame) -> DataFrame:
    """B1: the documents table as a single ordered text source."""
    return documents.select(
        F.lit(0).alias("src_ord"), F.lit("documents").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("part"),
        F.col("text"))


def conversations_corpus(conversations: DataFrame, src_ord: int = 1) -> DataFrame:
    """B1 for the conversations table: one text per (conv_id, turn)."""
    return conversations.select(
        F.lit(src_ord).alias("src_ord"), F.lit("conversations").alias("source"),
        F.col("conv_id").cast("long").alias("doc_id"), F.col("turn").cast("long").alias("part"),
        F.col("text"))


def ordered_union(*sources: DataFrame) -> DataFrame:
    """G1: UNION ALL of sources, first source first (``src_ord`` keeps the order)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def flatten_corpus(corpus: DataFrame) -> DataFrame:
    """B2: one document per line — LF becomes a space; NULL texts are skipped."""
    return corpus.where(F.col("text").isNotNull()).withColumn("text", flatten_newlines("text"))


def split_lines(df: DataFrame, order_cols: Sequence[str] = DOC_ORDER, text_col: str = "text",
                keep_empty: bool = False, lowercase: bool = False) -> DataFrame:
    """Text → lines (LF separated), trailing LF stripped (B3), optional lower.

    Empty lines are dropped unless ``keep_empty`` (B5: they form no sequence).
    Output: (*order_cols, line_no int, line string).
    """
    exploded = df.select(*order_cols, F.posexplode(F.split(F.col(text_col), "\n", -1))
                         .alias("line_no", "line"))
    out = exploded.select(*order_cols, F.col("line_no").cast("int").alias("line_no"),
                          normalize(strip_trailing_newlines("line"), lowercase).alias("line"))
    if not keep_empty:
        out = out.where(F.length("line") > 0)
    return out


def clean_corpus(corpus: DataFrame, order_cols: Sequence[str] = CORPUS_ORDER,
                 text_col: str = "text") -> DataFrame:
    """Collapse whitespace runs, trim, drop empty texts and exact duplicates.

    Duplicates keep the earliest row in order.  ``groupBy(text)`` runs as a
    partial + final hash aggregate, so a text repeated in a third of all rows
    is combined map-side before the shuffle.
    """
    cleaned = corpus.select(*order_cols, F.trim(F.regexp_replace(F.col(text_col), WHITESPACE, " "))
                            .alias(text_col))
    cleaned = cleaned.where(F.length(text_col) > 0)
    first = cleaned.groupBy(text_col).agg(F.min(F.struct(*order_cols)).alias("_k"))
    return first.select(*[F.col(f"_k.{c}").alias(c) for c in order_cols], text_col)


def byte_budget(corpus: DataFrame, budget_bytes: int, order_cols: Sequence[str] = CORPUS_ORDER,
                text_col: str = "text", newline_bytes: int = 1) -> DataFrame:
    """Keep texts, in order, while the running UTF-8 byte total ≤ budget.

    Each kept text costs its octet length plus ``newline_bytes`` (the line
    terminator of the text sink).  Only (order, size) is ranged and summed, by a
    two-level prefix sum; the least order key over the budget then cuts the
    corpus by a filter, so no text moves.  Order keys must be unique.
    """
    order = list(order_cols)
    sized = corpus.select(*order, (F.octet_length(text_col) + F.lit(newline_bytes)).cast("long").alias("_bytes"))
    with_off = exclusive_prefix_sum(sized, "_bytes", order, out_col="_before")
    over = with_off.where(F.col("_before") + F.col("_bytes") > F.lit(int(budget_bytes))) \
        .orderBy(*order).select(*order).first()
    if over is None:
        return corpus
    return corpus.where(F.struct(*order) < F.struct(*[F.lit(over[c]).cast(corpus.schema[c].dataType) for c in order]))
