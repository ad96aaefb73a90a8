"""Frequency operators.

Sums are combined in the tasks before the exchange: bytes and byte pairs in a
table of fixed size per task, other keys by partial aggregation, so a hot key
(a line or token that covers a third of the corpus) sends one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import adjacent_pairs
from ..session import cut_lineage, ship_package


def _weight(weight_col: str | None):
    return F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")


def token_frequency(seqs: DataFrame, tokens_col: str = "toks",
                    weight_col: str | None = None) -> DataFrame:
    """(token, n) over all sequences."""
    ex = seqs.select(F.explode(tokens_col).alias("token"), _weight(weight_col).alias("_w"))
    return ex.groupBy("token").agg(F.sum("_w").alias("n"))


def pair_frequency(seqs: DataFrame, tokens_col: str = "toks", weight_col: str | None = None,
                   order_cols: Sequence[str] | None = None) -> DataFrame:
    """Adjacent-pair counts (overlapping, so 'aaa' counts (a,a) twice).

    With ``order_cols`` also returns ``first`` = min(struct(order…, pos)): the
    first place the pair occurs in corpus order (the tie-break of F1).
    """
    cols = list(order_cols or [])
    ex = seqs.select(*cols, _weight(weight_col).alias("_w"),
                     F.explode(adjacent_pairs(tokens_col)).alias("p"))
    aggs = [F.sum("_w").alias("n")]
    if cols:
        aggs.append(F.min(F.struct(*[F.col(c) for c in cols], F.col("p.pos").alias("pos")))
                    .alias("first"))
    return ex.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(*aggs)


def top_pair(pairs: DataFrame, min_freq: int = 1) -> DataFrame:
    """the most frequent pair, ties to the first seen (needs ``first``)."""
    return pairs.where(F.col("n") >= min_freq).orderBy(F.desc("n"), F.asc("first")).limit(1)


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    col = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def _pair_codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, code) of the adjacent byte pairs inside one value."""
    inside = np.ones(max(len(raw) - 1, 0), bool)
    cut = off[1:-1]
    inside[cut[(cut > 0) & (cut < len(raw))] - 1] = False
    at = np.flatnonzero(inside)
    return at, raw[at].astype(np.int64) << 8 | raw[at + 1]


def _table(n: int, names: list[str], codes):
    """Counts of one task in a table of n entries; rows only for what occurred."""
    def run(batches):
        total = np.zeros(n, np.int64)
        for b in batches:
            total += np.bincount(codes(*_bytes_of(b.column(0))), minlength=n)
        at = np.flatnonzero(total)
        surfaces = [[f"{(int(c) >> 8 * k) & 255:02X}" for c in at] for k in range(len(names) - 1, -1, -1)]
        yield pa.RecordBatch.from_arrays([*(pa.array(s, pa.string()) for s in surfaces), pa.array(total[at])],
                                         names=[*names, "n"])
    return run


def byte_counts(df: DataFrame, col: str) -> DataFrame:
    """D1 on UTF-8 bytes: (token, n).  A task sends at most 256 rows."""
    ship_package(df.sparkSession)
    part = df.select(col).mapInArrow(_table(256, ["token"], lambda raw, off: raw), "token string, n long")
    return part.groupBy("token").agg(F.sum("n").alias("n"))


def byte_pair_counts(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """E1 + D2 on UTF-8 bytes of each line: (a, b, n) with hex surfaces.  A task
    counts in a table of 65,536 entries and sends at most that many rows."""
    ship_package(lines.sparkSession)
    part = lines.select(line_col).mapInArrow(
        _table(1 << 16, ["a", "b"], lambda raw, off: _pair_codes(raw, off)[1]), "a string, b string, n long")
    return part.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _first_places(codes: list[int], order_cols: list[str]):
    """The least (order…, pos) at which one task sees each code."""
    def run(batches):
        best: dict = {}
        for b in batches:
            raw, off = _bytes_of(b.column("_line"))
            at, seen = _pair_codes(raw, off)
            for c in codes:
                hit = at[seen == c]
                row, first = np.unique(np.searchsorted(off, hit, "right") - 1, return_index=True)
                for i, k in zip(row.tolist(), first.tolist()):
                    place = (*(b.column(o)[i].as_py() for o in order_cols), int(hit[k] - off[i]))
                    if c not in best or place < best[c]:
                        best[c] = place
        rows = [(f"{c >> 8:02X}", f"{c & 255:02X}", *p) for c, p in best.items()]
        cols = list(zip(*rows)) or [()] * (3 + len(order_cols))
        types = [pa.string()] * 2 + [pa.int64()] * (len(order_cols) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         names=["a", "b", *order_cols, "pos"])
    return run


def top_byte_pair(lines: DataFrame, order_cols: Sequence[str] = ("doc_id", "line_no"),
                  line_col: str = "line") -> DataFrame:
    """F1 on bytes: the most frequent pair, ties to the first seen, with its place.

    Places are only sought for the pairs that tie for the top count (of at
    most 65,536), one least place per task and pair."""
    order = list(order_cols)
    counts = cut_lineage(byte_pair_counts(lines, line_col))
    top = counts.agg(F.max("n")).first()[0]
    tied = counts.where(F.col("n") == F.lit(top))
    codes = [int(r["a"] + r["b"], 16) for r in tied.select("a", "b").collect()]
    schema = "a string, b string, " + ", ".join(f"{c} long" for c in order) + ", pos long"
    places = lines.select(*order, F.col(line_col).alias("_line")).mapInArrow(_first_places(codes, order), schema)
    return places.orderBy(*order, "pos").limit(1).withColumn("n", F.lit(top))


def source_counts(corpus: DataFrame, source_col: str = "source") -> DataFrame:
    """Rows and UTF-8 bytes written per source."""
    return corpus.groupBy(source_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))
