"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the given
tables, with an optional DuckDB oracle SQL over the same parquet views.

Every query reads whole tables (no id subsets, no row caps); a LIMIT appears
only where it is the feature (top-1 pair).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle.strip()
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    # Importing the modules runs their @register decorators.
    from . import q_corpus, q_tokenizer, q_pack, q_lm, q_vectors, q_stream  # noqa: F401
