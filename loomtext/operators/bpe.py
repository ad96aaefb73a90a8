"""Byte-pair-encoding models and their training.

Sequences are aggregated first: identical lines (line mode) or identical
pre-tokenized words (word mode) become one row ``(text, w, first)`` with a weight
``w`` and the first order key where they occur.  Weighted counts equal the
per-occurrence counts, and ``min(order key)`` keeps the first-seen tie-break.
``groupBy`` on the text runs with map-side partial aggregation, so a line that
fills a third of the corpus collapses before the shuffle.  The merge loop is in
``bpe_train``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DEFAULT_SPECIALS, WORD_PATTERN, normalize
from .bpe_train import HOT, learn_merges


@dataclass
class BpeModel:
    """A trained (or loaded) tokenizer.

    ``vocab`` rows are ``(token, id, kind)``: bytes and merges use the hex
    surface of their UTF-8 bytes, specials their literal string.  ``merges``
    are ``(a, b, n)`` in rank order.  Sizes are bounded by ``vocab_size``.
    """

    merges: list[tuple[str, str, int]]
    vocab: list[tuple[str, int, str]]
    specials: list[str] = field(default_factory=lambda: list(DEFAULT_SPECIALS))
    mode: str = "line"
    lowercase: bool = False
    byte_fallback: bool = True
    vocab_size: int = 32000
    min_freq: int = 2
    stop_reason: str = ""

    # --- lookups -----------------------------------------------------------
    def token_ids(self) -> dict[str, int]:
        return {t: i for t, i, _ in self.vocab}

    def special_id(self, name: str) -> int | None:
        for t, i, k in self.vocab:
            if k == "special" and t == name:
                return i
        return None

    def id_surfaces(self) -> dict[int, str]:
        """id → hex surface for bytes and merges (specials excluded)."""
        return {i: t for t, i, k in self.vocab if k != "special"}

    def merge_triples(self) -> list[tuple[int, int, int]]:
        """(id_a, id_b, id_ab) per merge, rank order."""
        ids = self.token_ids()
        return [(ids[a], ids[b], ids[a + b]) for a, b, _ in self.merges]

    # --- tables --------------------------------------------------------------
    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.vocab, "token string, id int, kind string")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r, a, b, int(n)) for r, (a, b, n) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, a string, b string, n long")

    def meta_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.mode, self.lowercase, self.byte_fallback, self.vocab_size, self.min_freq,
              self.stop_reason, self.specials)],
            "mode string, lowercase boolean, byte_fallback boolean, vocab_size int, "
            "min_freq int, stop_reason string, specials array<string>")


def base_vocab(specials: Sequence[str]) -> list[tuple[str, int, str]]:
    """256 byte tokens (id = byte), then specials not already present."""
    rows = [(f"{b:02X}", b, "byte") for b in range(256)]
    labels = {f"<0x{b:02x}>" for b in range(256)}
    seen: set[str] = set()
    for sp in specials:
        if sp in labels or sp in seen:
            continue
        seen.add(sp)
        rows.append((sp, len(rows), "special"))
    return rows


def order_key(cols: Sequence[str], df: DataFrame):
    """Order columns as one value, nulls first.  An integer, alone or with a 32-bit one
    after it, becomes a decimal, whose minimum is a hash aggregate (a struct's is a sort)."""
    types = [df.schema[c].dataType for c in cols]
    if len(cols) > 2 or not all(isinstance(t, T.IntegralType) for t in types) \
            or isinstance(types[-1], T.LongType) and len(cols) == 2:
        return F.struct(*[F.col(c) for c in cols])

    def number(c, null):
        return F.coalesce(F.col(c).cast("decimal(20,0)"), F.lit(str(null)).cast("decimal(20,0)"))

    value = number(cols[0], -(1 << 63) - 1)
    if len(cols) == 2:
        value = value * F.lit(1 << 33).cast("decimal(11,0)") + number(cols[1], -(1 << 31) - 1)
    return value.cast("decimal(38,0)")


def line_sequences(lines: DataFrame, order_cols: Sequence[str], line_col: str = "line",
                   lowercase: bool = False) -> DataFrame:
    """Distinct non-empty lines: (text, w, first)."""
    norm = lines.select(normalize(line_col, lowercase).alias("text"),
                        order_key(order_cols, lines).alias("_k")).where(F.length("text") > 0)
    return norm.groupBy("text").agg(F.count(F.lit(1)).alias("w"), F.min("_k").alias("first"))


def word_sequences(lines: DataFrame, order_cols: Sequence[str], line_col: str = "line",
                   lowercase: bool = False, pattern: str = WORD_PATTERN) -> DataFrame:
    """Distinct pre-tokenized words: (text, w, first)."""
    words = lines.select(
        F.struct(*[F.col(c) for c in order_cols]).alias("_k"),
        F.posexplode(F.regexp_extract_all(normalize(line_col, lowercase), F.lit(pattern), 0))
        .alias("_wpos", "text")).where(F.length("text") > 0)
    return words.groupBy("text").agg(F.count(F.lit(1)).alias("w"),
                                     F.min(F.struct("_k", "_wpos")).alias("first"))


def train_bpe(sequences: DataFrame, vocab_size: int = 32000, min_freq: int = 2,
              specials: Sequence[str] | None = None, mode: str = "line",
              lowercase: bool = False, byte_fallback: bool = True,
              tie_break: str = "first_seen", hot: int = HOT, log: str | None = None,
              max_rounds: int | None = None) -> BpeModel:
    """Learn merges until the vocabulary is full or a stop rule fires.

    Stop rules (in order): no pairs left; best count < ``min_freq``; the merged
    surface is already a token.  ``tie_break``: ``first_seen`` (earliest
    occurrence in corpus order) or ``smallest`` (lexicographically smallest
    (a, b) surfaces).  ``sequences`` is the output of ``line_sequences`` /
    ``word_sequences``.  ``log`` is a folder that keeps the merges of every round, from
    which a later call goes on; ``max_rounds`` ends early.
    """
    specials = list(DEFAULT_SPECIALS if specials is None else specials)
    vocab = base_vocab(specials)
    if tie_break == "smallest":
        sequences = sequences.select("text", "w")
    merges, stop = learn_merges(sequences, len(vocab), max(0, vocab_size - len(vocab)), min_freq,
                                tie_break, hot, log, max_rounds)
    vocab += [(a + b, len(vocab) + i, "merge") for i, (a, b, _) in enumerate(merges)]
    return BpeModel(merges=merges, vocab=vocab, specials=specials, mode=mode,
                    lowercase=lowercase, byte_fallback=byte_fallback, vocab_size=vocab_size,
                    min_freq=min_freq, stop_reason=stop)


def train_line_bpe(lines: DataFrame, order_cols: Sequence[str] = ("doc_id", "line_no"),
                   line_col: str = "line", vocab_size: int = 32000, min_freq: int = 2,
                   specials: Sequence[str] | None = None, lowercase: bool = False,
                   byte_fallback: bool = True, **kw) -> BpeModel:
    """Line BPE — a whole line is one sequence; merges may cross spaces."""
    seqs = line_sequences(lines, list(order_cols), line_col, lowercase)
    return train_bpe(seqs, vocab_size=vocab_size, min_freq=min_freq, specials=specials,
                     mode="line", lowercase=lowercase, byte_fallback=byte_fallback, **kw)


def train_word_bpe(lines: DataFrame, order_cols: Sequence[str] = ("doc_id", "line_no"),
                   line_col: str = "line", vocab_size: int = 32000, min_freq: int = 2,
                   specials: Sequence[str] | None = None, lowercase: bool = False, **kw) -> BpeModel:
    """Word BPE — regex pre-tokenization, merges never cross a word.

    Ties go to the lexicographically smallest pair of surfaces (the external
    trainer's exact tie rule is not specified; this one is deterministic).
    """
    seqs = word_sequences(lines, list(order_cols), line_col, lowercase)
    kw.setdefault("tie_break", "smallest")
    return train_bpe(seqs, vocab_size=vocab_size, min_freq=min_freq, specials=specials,
                     mode="word", lowercase=lowercase, **kw)
