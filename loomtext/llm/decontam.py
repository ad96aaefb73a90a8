"""Operator 7: benchmark decontamination by a prefix-filtered join (native).

Items are cut into windows of ``WINDOW`` words, windows into shingles of
``SHINGLE`` words.  One pass over the documents joins their shingles to the
benchmark's and keeps the hits (document, position, shingle), compared by their
words, not by hash alone.  Shingles are ordered by rarity in the documents; exact
containment needs every shingle of a window, so the necessary prefix is the
rarest one.  A hit on it proposes where the window would start, the
positional and length bounds drop starts that do not fit in the document, and a
window counts once all its shingles are found at their places.

Defined cases: null text has no words; an item without words is ignored; an
item shorter than a window is one window; repeated items and windows count
once per item; repeated documents are separate rows; empty tables on either
side give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, text_or_empty

WINDOW, SHINGLE = 10, 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A benchmark of at most so many distinct shingles (some 100 bytes each) is
#: broadcast; a larger one joins by a shuffle.
BROADCAST_SHINGLES = 500_000


def words(col: str) -> Column:
    """Words of the lower-cased text, in order."""
    return F.filter(F.split(lower_ascii(text_or_empty(col)), SEPARATORS), lambda w: w != F.lit(""))


def _shingles(ws: Column, width: int) -> Column:
    """array<struct<w0,w1,w2>>: one for each position; words past ``width`` are null."""
    none = F.lit(None).cast("string")
    cols = [ws] + [F.slice(ws, i + 1, F.greatest(F.size(ws) - i, F.lit(0))) for i in range(1, width)]
    zipped = F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(cols)])
    return F.transform(zipped, lambda z: F.struct(*[
        (z[f"w{i}"] if i < width else none).alias(f"w{i}") for i in range(SHINGLE)]))


def _key(width: Column | int) -> Column:
    return F.xxhash64(F.col("s.w0"), F.col("s.w1"), F.col("s.w2"), F.lit(width))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """Distinct (item, win array<string>)."""
    ws = benchmark.select(F.col(item).alias("item"), words(text).alias("ws")).where("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    return ws.select("item", "ws", F.explode(starts).alias("at")) \
        .select("item", F.slice("ws", F.col("at"), window).alias("win")).distinct()


def _document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(_rid, key, n_words, pos, width, s): all shingles; a document without words has one row."""
    parts = []
    for w in widths:
        parts.append(docs.select("_rid", "_key", "n_words", F.lit(w).alias("width"),
                                 F.posexplode_outer(_shingles(F.col("_ws"), w)).alias("pos", "s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.where("pos is not null"))
    return out


def window_occurrences(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                       text: str = "text", item: str = "item_id", item_text: str = "text",
                       window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents (_rid, key, n_words), occurrences (_rid, start, len, wid), windows (wid, item))."""
    wins = materialize(item_windows(benchmark, item, item_text, window)
                       .withColumn("wid", F.xxhash64("win")), "windows")
    # A window's identifier is its words' hash plus a number among equal hashes.
    wins = wins.withColumn("wid", F.struct("wid", F.dense_rank().over(
        Window.partitionBy("wid").orderBy("win")).alias("k")))
    one = wins.select("wid", "win", F.size("win").alias("len"),
                      F.least(F.size("win"), F.lit(SHINGLE)).alias("width")).distinct()
    widths = sorted(r.width for r in one.select("width").distinct().collect()) or [SHINGLE]
    parts = [one.where(F.col("width") == w).select(
        "wid", "len", "width", F.posexplode(F.slice(
            _shingles(F.col("win"), w), 1, F.size("win") - w + 1)).alias("off", "s")) for w in widths]
    inside = parts[0]
    for p in parts[1:]:
        inside = inside.unionByName(p)
    inside = materialize(inside.withColumn("h", _key(F.col("width"))), "window-shingles")

    # Distinct benchmark shingles, numbered among those of one hash (all 1 as a rule).
    known = inside.select(F.col("h").alias("bh"), F.col("s").alias("bs"), F.col("width").alias("bw")) \
        .distinct().withColumn("bk", F.row_number().over(
            Window.partitionBy("bh").orderBy("bs.w0", "bs.w1", "bs.w2", "bw")))
    n_known = known.count()
    d = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_key"),
                    words(text).alias("_ws")).withColumn("n_words", F.size("_ws").cast("long"))
    rows = _document_shingles(d, widths).withColumn("h", _key(F.col("width")))
    # Joined on the 64-bit hash alone (a long key); the words are compared after it.
    joined = rows.join(F.broadcast(known) if n_known <= BROADCAST_SHINGLES else known,
                       F.col("h") == F.col("bh"), "left")
    same = F.coalesce(_equal_words(F.col("s"), F.col("bs")) & (F.col("width") == F.col("bw")), F.lit(False))
    first = (F.col("width") == widths[0]) & (F.coalesce("pos", F.lit(0)) == 0) \
        & (F.coalesce("bk", F.lit(1)) == 1)
    table = materialize(joined.where(same | first).select(
        "_rid", "_key", "n_words", first.alias("first"), F.col("pos").cast("long").alias("pos"),
        F.when(same, F.col("s")).alias("s"), "width"), "hits")

    documents = table.where("first").select("_rid", F.col("_key").alias(key), "n_words")
    hits = table.where("s is not null").select("_rid", "n_words", "pos", "s", "width")
    rarity = hits.groupBy("s", "width").agg(F.count(F.lit(1)).alias("n"))
    # A window with a shingle that no document has cannot occur; the rest are
    # joined on their rarest shingle (ties: the words, then the place).
    order = Window.partitionBy("wid").orderBy("n", "s.w0", "s.w1", "s.w2", "off")
    need = Window.partitionBy("wid")
    ranked = inside.join(rarity, _same_shingle(inside, rarity), "left") \
        .select(inside.wid, inside.len, inside.off, inside.s, inside.width, rarity.n)
    prefix = ranked.withColumn("_missing", F.max(F.col("n").isNull()).over(need)) \
        .where("not _missing").withColumn("_r", F.row_number().over(order)).where("_r = 1") \
        .select("wid", "len", "off", F.col("s").alias("ps"), F.col("width").alias("pw"))
    found = hits.join(prefix, _equal_words(F.col("s"), F.col("ps")) & (F.col("width") == F.col("pw"))) \
        .select("_rid", "n_words", (F.col("pos") - F.col("off")).alias("start"), "wid", "len") \
        .where("start >= 0 and start + len <= n_words").drop("n_words").distinct()
    wanted = found.join(inside.select(F.col("wid").alias("iwid"), "off", F.col("s").alias("ws"),
                                      F.col("width").alias("ww")), F.col("wid") == F.col("iwid")) \
        .select("_rid", "start", "wid", "len", (F.col("start") + F.col("off")).alias("wpos"), "ws", "ww")
    seen = hits.select(F.col("_rid").alias("hrid"), "pos", "s", "width")
    checked = wanted.join(seen, (F.col("_rid") == F.col("hrid")) & (F.col("wpos") == F.col("pos"))
                          & (F.col("ww") == F.col("width")) & _equal_words(F.col("ws"), F.col("s"))) \
        .groupBy("_rid", "start", "wid", "len").agg(F.count(F.lit(1)).alias("n"), F.first("ww").alias("w")) \
        .where("n = len - w + 1").select("_rid", "start", "len", "wid")
    return documents, materialize(checked, "occurrences"), wins.select("wid", "item").distinct()


def _equal_words(a: Column, b: Column) -> Column:
    return (a["w0"] == b["w0"]) & a["w1"].eqNullSafe(b["w1"]) & a["w2"].eqNullSafe(b["w2"])


def _same_shingle(a: DataFrame, b: DataFrame) -> Column:
    return _equal_words(a["s"], b["s"]) & (a["width"] == b["width"])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    documents, occ, items = window_occurrences(docs, benchmark, key, text, item, item_text, window)
    spans = occ.groupBy("_rid", "start").agg(F.max("len").alias("len"))
    earlier = Window.partitionBy("_rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    hit = spans.withColumn("_end", F.coalesce(F.max(end).over(earlier), F.lit(0))) \
        .groupBy("_rid").agg(F.sum(F.greatest(end - F.greatest("start", "_end"), F.lit(0))).alias("n_hit"))
    named = occ.select("_rid", "wid").distinct().join(items, "wid").groupBy("_rid") \
        .agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("_items"))
    none = F.array().cast("array<string>")
    listed = F.coalesce("_items", none)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return documents.join(hit, "_rid", "left").join(named, "_rid", "left").select(
        key, "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
