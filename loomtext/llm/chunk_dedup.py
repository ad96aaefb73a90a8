"""Operator 9: exact dedup over content-defined chunk recipes (native).

A normalised text (A-Z lowered) is cut where its own content says so: after a
word whose last letter is in a fixed set, at least ``MIN_CHUNK`` and at most
``MAX_CHUNK`` characters after the last cut.  A chunk's identifier is its
64-bit hash, verified once: the distinct (hash, chunk) pairs are counted per
hash, and chunks that share a hash are told apart by a number.  Documents are
then equal when their ordered identifier lists are equal, so a document's text
moves at most once (as distinct chunks) and only short lists are compared.

Defined cases: null text counts as empty (equal to other empty texts); a null
key loses against any other key; of repeated rows with one key one row stays;
an empty table gives an empty result.  Extra columns are dropped by
``exact_groups`` and kept by ``drop_exact_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_given, aside, set_aside, lower_ascii, materialize, text_or_empty

MIN_CHUNK, MAX_CHUNK = 512, 4096
CUT = (rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[bdfhkmpw-z0-9][\s\p{{Punct}}]"
       rf"|(?s).{{1,{MAX_CHUNK}}}")


def chunks(norm: Column) -> Column:
    """The content-defined chunks of a normalised text, in order (none if empty)."""
    return F.regexp_extract_all(norm, F.lit(CUT), F.lit(0))


def colliding_chunks(norm: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """(h, chunk, k): chunks whose hash another chunk shares, numbered per hash."""
    pairs = norm.select(F.explode(chunks(F.col("_norm"))).alias("chunk")) \
        .select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = materialize(pairs.groupBy("h").count().where("count > 1").select("h"), "shared-hashes")
    if shared.isEmpty():
        return shared.select("h", F.lit("").alias("chunk"), F.lit(0).alias("k")).limit(0)
    return pairs.join(shared, "h").withColumn(
        "k", F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1)


def recipes(norm: DataFrame, keep: list[str],
            chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """Per row: the ``keep`` columns, ``_rid`` and ``recipe`` array<struct<h,k>>.

    Without a shared hash (the check is over all chunks) the recipe is computed
    in place.  With one, chunks are joined to the numbered table by hash and
    text, and lists are rebuilt per row.
    """
    shared = colliding_chunks(norm, chunk_hash)
    rows = norm.withColumn("_rid", F.monotonically_increasing_id())
    if shared.isEmpty():
        out = rows.select(*keep, "_rid", F.transform(chunks(F.col("_norm")), lambda c: F.struct(
            chunk_hash(c).alias("h"), F.lit(0).alias("k"))).alias("recipe"))
        return materialize(out, "recipes")
    rows = materialize(rows.select(*keep, "_rid", "_norm"), "rows")
    parts = rows.select("_rid", F.posexplode(chunks(F.col("_norm"))).alias("pos", "chunk")) \
        .withColumn("h", chunk_hash(F.col("chunk")))
    lists = parts.join(shared, ["h", "chunk"], "left").groupBy("_rid").agg(
        F.sort_array(F.collect_list(F.struct("pos", "h", F.coalesce("k", F.lit(0)).alias("k"))))
        .alias("_l"))
    out = rows.select(*keep, "_rid").join(lists, "_rid", "left").withColumn(
        "recipe", F.coalesce(F.transform("_l", lambda x: F.struct(x["h"].alias("h"), x["k"].alias("k"))),
                             F.expr("array()").cast("array<struct<h:bigint,k:int>>"))).drop("_l")
    return materialize(out, "recipes")


def _grouped(df: DataFrame, key: str, text: str, keep: list[str],
             chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """recipes + keep_id, group_size, kept."""
    norm = df.withColumn("_norm", lower_ascii(text_or_empty(text))) \
        .withColumn("_sha", F.sha2(F.col("_norm"), 256))
    r = recipes(norm, keep + ["_sha"], chunk_hash) \
        .withColumn("_rd", F.xxhash64("recipe"))
    groups = r.groupBy("recipe").agg(
        F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
        F.coalesce(F.max_by("_rid", key), F.max("_rid")).alias("_keep_rid")) \
        .withColumn("_rd", F.xxhash64("recipe"))
    return r.join(groups, ["_rd", "recipe"]).withColumn("kept", F.col("_rid") == F.col("_keep_rid"))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text",
                 chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256."""
    return _grouped(df.select(key, text), key, text, [key], chunk_hash).select(
        key, "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def drop_exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text",
                      chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The rows of ``df`` that stay, all columns.

    Staying rows are named by (key, text digest); the semi join on those short
    names leaves the rows dealt and sorted so that the window, which keeps one
    of repeated rows, needs no further exchange.
    """
    def name(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit(""))

    rows, k, t = set_aside(df), aside(df, key), aside(df, text)
    kept = _grouped(rows.select(k, t), k, t, [k], chunk_hash).where("kept") \
        .select(name(k).alias("_jk"), "_sha")
    tagged = rows.withColumn("_jk", name(k)) \
        .withColumn("_sha", F.sha2(lower_ascii(text_or_empty(t)), 256))
    one = Window.partitionBy("_jk", "_sha").orderBy("_jk", "_sha")
    return as_given(tagged.join(kept, ["_jk", "_sha"], "left_semi")
                    .withColumn("_n", F.row_number().over(one)).where("_n = 1"), df)
