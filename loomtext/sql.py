"""2.K: SQL surface — register the tokenizer as SQL-callable functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .operators.bpe import BpeModel
from .operators.codec import decode_udf, encode_udf


def register(spark: SparkSession, model: BpeModel, prefix: str = "bpe") -> None:
    """Expose ``{prefix}_encode(text)``, ``{prefix}_encode_bos_eos(text)`` and
    ``{prefix}_decode(ids)`` to ``spark.sql`` (Arrow-batched UDFs)."""
    spark.udf.register(f"{prefix}_encode", encode_udf(model))
    spark.udf.register(f"{prefix}_encode_bos_eos", encode_udf(model, True, True))
    spark.udf.register(f"{prefix}_decode", decode_udf(model))
