"""Encode / decode.

Encoding runs in ``mapInArrow``: all lines of an Arrow batch are laid end to
end in one numpy id array with segment offsets, and each merge pass is a
handful of vectorized numpy operations over the whole batch — no per-line
Python loop, no per-row Python objects in or out.  The merge table (bounded by
the vocabulary size) travels in the closure, i.e. it is broadcast once per
task.  SQL-callable pandas UDFs wrap the same kernels (2.K).

Line mode (T2) merges *any* adjacent pair that is in the merge set, scanning
left to right and skipping the second element of each merge, until nothing
changes.  In a run of consecutive mergeable positions starting at s the scan
merges exactly s, s+2, s+4, … — that is the vectorized rule below.

Word mode merges by rank: in each pass every word merges all (non-overlapping,
left to right) occurrences of its lowest-rank adjacent pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WORD_PATTERN, normalize
from ..session import ship_package
from .bpe import BpeModel
from .kernels import gather, merge_by_rank, merge_set_fixpoint, pair_table, utf8_ids


def _ship_active() -> None:
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    if s is not None:
        ship_package(s)


def _to_arrow_lists(ids, offsets, prefix=None, suffix=None) -> pa.Array:
    if prefix is not None or suffix is not None:
        lengths = np.diff(offsets)
        extra = (prefix is not None) + (suffix is not None)
        new_off = np.concatenate([[0], np.cumsum(lengths + extra)]).astype(np.int64)
        out = np.empty(new_off[-1], np.int64)
        starts = new_off[:-1]
        body = np.ones(len(out), bool)
        if prefix is not None:
            out[starts] = prefix
            body[starts] = False
        if suffix is not None:
            out[new_off[1:] - 1] = suffix
            body[new_off[1:] - 1] = False
        out[body] = ids
        ids, offsets = out, new_off
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                    pa.array(ids.astype(np.int32), pa.int32()))


# ---------------------------------------------------------------------------
# Arrow plumbing
# ---------------------------------------------------------------------------
def list_ids(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Arrow list<int> array → (flat int64, offsets int64[len+1]); NULL = []."""
    arr = arr.cast(pa.large_list(pa.int64()))
    if arr.null_count:
        arr = pa.array([x if x is not None else [] for x in arr.to_pylist()],
                       pa.large_list(pa.int64()))
    offs = np.asarray(arr.offsets, np.int64)
    flat = np.asarray(arr.values, np.int64)[offs[0]:offs[-1]]
    return flat, offs - offs[0]


class Codec:
    """Vectorized encode/decode tables for one model (all bounded by vocab size)."""

    def __init__(self, model: BpeModel, add_bos: bool = False, add_eos: bool = False):
        ids = model.token_ids()
        self.mode = model.mode
        self.width = max(i for _, i, _ in model.vocab) + 1
        self.table = pair_table(model.merge_triples(), self.width)
        self.byte_ids = np.array([ids[f"{b:02X}"] for b in range(256)], np.int64)
        self.bos = model.special_id("<bos>") if add_bos else None
        self.eos = model.special_id("<eos>") if add_eos else None
        surf = model.id_surfaces()
        blobs = [bytes.fromhex(surf[i]) if i in surf else b"" for i in range(self.width)]
        self.lens = np.array([len(b) for b in blobs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)
        joined = b"".join(blobs)
        self.pool = np.frombuffer(joined, np.uint8) if joined else np.zeros(0, np.uint8)

    def encode_array(self, texts: pa.Array) -> pa.Array:
        data, offsets = utf8_ids(texts)
        rule = merge_set_fixpoint if self.mode == "line" else merge_by_rank
        ids, offsets = rule(self.byte_ids[data], offsets, self.table, self.width)
        return _to_arrow_lists(ids, offsets, self.bos, self.eos)

    def encode_words(self, words: pa.Array) -> pa.Array:
        """list<string> words → list<int> ids; distinct words encoded once."""
        words = words.cast(pa.large_list(pa.large_string()))
        if words.null_count:
            words = pa.array([w if w is not None else [] for w in words.to_pylist()],
                             pa.large_list(pa.large_string()))
        woffs = np.asarray(words.offsets, np.int64)
        flat = words.values.slice(int(woffs[0]), int(woffs[-1] - woffs[0]))
        woffs = woffs - woffs[0]
        enc = flat.dictionary_encode()
        data, offsets = utf8_ids(enc.dictionary)
        ids, offsets = merge_by_rank(self.byte_ids[data], offsets, self.table, self.width)
        codes = np.asarray(enc.indices.fill_null(0), np.int64)
        out, word_tok_off = gather(ids, offsets, codes)  # each occurrence's ids in order
        row_off = word_tok_off[woffs]
        return _to_arrow_lists(out, row_off, self.bos, self.eos)

    def decode_array(self, ids_arr: pa.Array) -> pa.Array:
        flat, offs = list_ids(ids_arr)
        if len(flat) and ((flat < 0) | (flat >= self.width)).any():
            raise ValueError("decode: id outside the vocabulary")
        tl = self.lens[flat]
        total = int(tl.sum())
        rep = np.repeat(np.arange(len(flat)), tl)
        tok_out = np.concatenate([[0], np.cumsum(tl)[:-1]]).astype(np.int64)
        within = np.arange(total, dtype=np.int64) - tok_out[rep] if total else np.zeros(0, np.int64)
        data = self.pool[self.starts[flat][rep] + within] if total else np.zeros(0, np.uint8)
        cum = np.concatenate([[0], np.cumsum(tl)]).astype(np.int64)
        row_off = cum[offs]
        return pa.BinaryArray.from_buffers(
            pa.binary(), len(offs) - 1,
            [None, pa.py_buffer(row_off.astype(np.int32).tobytes()),
             pa.py_buffer(data.astype(np.uint8).tobytes())])


#: Bytes of a batch that are worked on at a time: numpy needs many times that.
SLICE = 1 << 20


def _slices(batch: pa.RecordBatch):
    """The rows of a batch, in parts of about SLICE bytes."""
    rows = max(1, len(batch) * SLICE // max(1, batch.get_total_buffer_size()))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def _map_column(df: DataFrame, src: str, out_col: str, out_type, fn, leave: Sequence[str] = ()) -> DataFrame:
    """mapInArrow adding ``out_col`` = fn(batch column ``src``), without the columns ``leave``."""
    ship_package(df.sparkSession)
    sent = [f.name for f in df.schema.fields if f.name != out_col and (f.name == src or f.name not in leave)]
    fields = [f for f in df.schema.fields if f.name in sent and f.name not in leave]
    schema = T.StructType(fields + [T.StructField(out_col, out_type, True)])
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for b in _slices(batch):
                cols = [b.column(n) for n in names]
                out = fn(b.column(src))
                yield pa.RecordBatch.from_arrays(cols + [out], names=names + [out_col])

    return df.select(*sent).mapInArrow(run, schema)


def encode(df: DataFrame, model: BpeModel, text_col: str = "line", out_col: str = "ids",
           add_bos: bool = False, add_eos: bool = False,
           pattern: str = WORD_PATTERN, keep_text: bool = True) -> DataFrame:
    """Add ``out_col`` = token ids of ``text_col``.

    Without ``keep_text`` the text goes to the encoder and does not come back.

    Line mode: the whole text is one sequence (T2 set-fixpoint rule).
    Word mode: regex pre-tokenization (built-in, JVM side), then rank-ordered
    merges per word; distinct words of a batch are encoded once.
    """
    codec = Codec(model, add_bos, add_eos)
    ids_t = T.ArrayType(T.IntegerType())
    leave = ["_enc_in"] if keep_text else ["_enc_in", text_col]
    if model.mode == "line":
        src = df.withColumn("_enc_in", normalize(text_col, model.lowercase))
        return _map_column(src, "_enc_in", out_col, ids_t, codec.encode_array, leave)
    src = df.withColumn("_enc_in", F.regexp_extract_all(
        normalize(text_col, model.lowercase), F.lit(pattern), 0))
    return _map_column(src, "_enc_in", out_col, ids_t, codec.encode_words, leave)


def byte_ids_of(df: DataFrame, text_col: str = "line", out_col: str = "ids") -> DataFrame:
    """H1 as ids: add the UTF-8 bytes of a text, straight from the Arrow buffers."""
    return _map_column(df, text_col, out_col, T.ArrayType(T.IntegerType()),
                       lambda texts: _to_arrow_lists(*utf8_ids(texts)))


def decode(df: DataFrame, model: BpeModel, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Ids → text.  Bytes are concatenated in order (the reversible contract,
    T3); specials are skipped (B6); malformed UTF-8 becomes U+FFFD (H6)."""
    codec = Codec(model)
    out = _map_column(df, ids_col, "_dec_bytes", T.BinaryType(), codec.decode_array)
    return out.withColumn(out_col, F.make_valid_utf8(F.col("_dec_bytes").cast("string"))) \
              .drop("_dec_bytes")


def encode_udf(model: BpeModel, add_bos: bool = False, add_eos: bool = False):
    """SQL-callable pandas UDF: text → array<int> (2.K ``bpe_encode``)."""
    codec = Codec(model, add_bos, add_eos)
    _ship_active()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def bpe_encode(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        texts = texts.fillna("")
        if codec.mode == "line":
            res = codec.encode_array(pa.array(texts, pa.large_string()))
        else:  # the word pattern, by a regex engine that knows \\p{L} and lookahead
            import regex

            find = regex.compile(WORD_PATTERN.removeprefix("(?U)")).findall
            res = codec.encode_words(pa.array([find(t) for t in texts], pa.large_list(pa.large_string())))
        flat, offs = list_ids(res)
        out = pd.Series(np.split(flat.astype(np.int32), offs[1:-1]) if len(offs) > 1 else [], dtype=object)
        return out.where(known, None)  # NULL stays NULL

    return bpe_encode


def decode_udf(model: BpeModel):
    """SQL-callable pandas UDF: array<int> → string (2.K ``bpe_decode``)."""
    codec = Codec(model)
    _ship_active()

    @F.pandas_udf(T.StringType())
    def bpe_decode(ids: pd.Series) -> pd.Series:
        raw = codec.decode_array(pa.array(ids, pa.large_list(pa.int64())))
        return pd.Series([b.decode("utf-8", errors="replace") for b in raw.to_pylist()])

    return bpe_decode


def pieces(df: DataFrame, model: BpeModel, ids_col: str = "ids", out_col: str = "pieces") -> DataFrame:
    """L2: ids → token labels ('<0x48><0x65>' for bytes/merges, specials as is)."""
    width = max(i for _, i, _ in model.vocab) + 1
    labels = [""] * width
    for t, i, k in model.vocab:
        labels[i] = t if k == "special" else "".join(
            f"<0x{t[j:j + 2].lower()}>" for j in range(0, len(t), 2))
    lab = pa.array(labels, pa.string())

    def fn(arr):
        flat, offs = list_ids(arr)
        vals = lab.take(pa.array(flat, pa.int64()))
        return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), vals)

    return _map_column(df, ids_col, out_col, T.ArrayType(T.StringType()), fn)


def token_to_id(tokens: DataFrame, model: BpeModel, token_col: str = "token",
                out_col: str = "id") -> DataFrame:
    """Surface → id with the fallback chain vocab → own bytes → ``<unk>``.

    With ``byte_fallback`` a surface that is not in the vocabulary but is a valid
    run of hex bytes becomes the ids of those bytes (an array); any other one
    becomes ``<unk>``.  The vocabulary side is broadcast (bounded by its size).
    """
    spark = tokens.sparkSession
    vocab = F.broadcast(model.vocab_df(spark).select(F.col("token").alias("_t"),
                                                     F.col("id").alias("_id")))
    unk = model.special_id("<unk>")
    j = tokens.join(vocab, tokens[token_col] == vocab["_t"], "left")
    if model.byte_fallback:
        by_byte = {t: i for t, i, k in model.vocab if k == "byte"}
        byte_ids = F.array(*[F.lit(by_byte[f"{b:02X}"]) for b in range(256)])
        fb = F.when(F.col(token_col).rlike("^([0-9A-F]{2})+$"), F.transform(
            F.regexp_extract_all(F.col(token_col), F.lit(".."), 0),
            lambda h: F.get(byte_ids, F.conv(h, 16, 10).cast("int")))) \
            .otherwise(F.array(F.lit(unk).cast("int")))
    else:
        fb = F.array(F.lit(unk).cast("int"))
    return j.withColumn(out_col, F.when(F.col("_id").isNotNull(), F.array("_id")).otherwise(fb)) \
            .drop("_t", "_id")


def id_to_token(ids: DataFrame, model: BpeModel, id_col: str = "id",
                out_col: str = "token") -> DataFrame:
    """Id → surface via a broadcast join; unknown ids are an error (anti-join check)."""
    spark = ids.sparkSession
    vocab = F.broadcast(model.vocab_df(spark).select(F.col("id").alias(id_col),
                                                     F.col("token").alias(out_col), "kind"))
    bad = ids.join(vocab, id_col, "left_anti").limit(1).count()
    if bad:
        raise ValueError("id_to_token: id outside the vocabulary")
    return ids.join(vocab, id_col, "inner")


def merge_pairs_in_corpus(pairs: DataFrame, model: BpeModel) -> DataFrame:
    """Adjacent pairs (a, b surfaces) that are in the merge set (semi-join)."""
    spark = pairs.sparkSession
    m = F.broadcast(model.merges_df(spark).select("a", "b"))
    return pairs.join(m, ["a", "b"], "left_semi")
