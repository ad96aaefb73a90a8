"""Data-quality and split jobs (L1, L3, L4, L7).  L5/L6 live in ``corpus``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codec
from .bpe import BpeModel


def roundtrip(df: DataFrame, model: BpeModel, text_col: str = "line") -> DataFrame:
    """L1: adds ids, decoded text and ``ok`` = decode(encode(x)) == normalize(x)."""
    enc = codec.encode(df, model, text_col, "_ids")
    dec = codec.decode(enc, model, "_ids", "_back")
    want = F.lower(text_col) if model.lowercase else F.col(text_col)
    return dec.withColumn("ok", F.col("_back") == want).drop("_ids", "_back")


def assign_split(df: DataFrame, key_col: str = "doc_id", val_permille: int = 100,
                 seed: int = 42, method: str = "hash", val_every: int = 10) -> DataFrame:
    """L3: deterministic train/val split per key (no global state, no shuffle).

    ``hash``: ``pmod(xxhash64(seed, key), 1000) < val_permille`` → 'val'.
    ``modulo``: ``pmod(key, val_every) == 0`` → 'val' (easy to mirror in SQL).
    """
    if method == "hash":
        is_val = F.pmod(F.xxhash64(F.lit(seed), F.col(key_col)), F.lit(1000)) < val_permille
    else:
        is_val = F.pmod(F.col(key_col), F.lit(int(val_every))) == 0
    return df.withColumn("split", F.when(is_val, "val").otherwise("train"))


def leakage(df: DataFrame, text_col: str = "text", split_col: str = "split") -> DataFrame:
    """L4: texts present in both splits, with their row counts per split.

    A pivoted aggregate over ``groupBy(text)`` (partial aggregation keeps a
    hot duplicate cheap); no self-join.
    """
    g = df.groupBy(text_col).agg(
        F.sum(F.when(F.col(split_col) == "train", 1).otherwise(0)).cast("long").alias("n_train"),
        F.sum(F.when(F.col(split_col) == "val", 1).otherwise(0)).cast("long").alias("n_val"))
    return g.where((F.col("n_train") > 0) & (F.col("n_val") > 0))


def id_range_report(encoded: DataFrame, vocab: DataFrame, ids_col: str = "ids",
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Ids must fit uint32 storage and lie in the vocabulary.

    Reports max id, count of ids outside [0, 2^32) and count of ids missing
    from ``vocab``, whose ids are dense from 0 (checked).  Counted inside each
    row's array: no token becomes a row and nothing is joined.
    """
    size, top = vocab.agg(F.countDistinct("id"), F.max("id")).first()
    if size and top != size - 1:
        raise ValueError("vocabulary ids are not dense 0..V-1")
    ids = F.transform(ids_col, lambda i: i.cast("long"))

    def outside(bound: int):
        return F.size(F.filter("_ids", lambda i: (i < 0) | (i >= F.lit(bound)))).cast("long")

    rows = encoded.select(*group_cols, ids.alias("_ids"), F.array_max(ids_col).alias("_max"))
    return rows.groupBy(*group_cols).agg(
        F.sum(F.size("_ids").cast("long")).alias("n_ids"), F.max("_max").alias("max_id"),
        F.sum(outside(2 ** 32)).alias("n_out_of_range"), F.sum(outside(size)).alias("n_unknown"))
