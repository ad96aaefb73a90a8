"""Tokenizer persistence.

Native format: a directory with three parquet tables ``vocab`` (token, id,
kind, label), ``merges`` (rank, a, b, n) and ``meta``.  Word-mode artefacts
are also written/read in the byte-level ``vocab.json`` + ``merges.txt`` form
(byte-level unicode alphabet), each as a one-part Spark text output.

All tables here are bounded by ``vocab_size`` (a parameter), so collecting
them to build a model object is a bounded transfer.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import byte_label
from ..operators.bpe import BpeModel
from .tables import read_text_lines


def save_model(spark: SparkSession, model: BpeModel, path: str) -> None:
    """Write vocab / merges / meta (one small file each)."""
    vocab = model.vocab_df(spark)
    label = F.when(F.col("kind") == "special", F.col("token")).otherwise(
        F.array_join(F.transform(F.regexp_extract_all("token", F.lit(".."), 0),
                                 lambda h: byte_label(h)), ""))
    vocab.withColumn("label", label).coalesce(1).write.mode("overwrite") \
        .parquet(os.path.join(path, "vocab"))
    model.merges_df(spark).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "merges"))
    model.meta_df(spark).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))


def load_model(spark: SparkSession, path: str) -> BpeModel:
    """Read the three tables back and rebuild the model (id order dense)."""
    meta = spark.read.parquet(os.path.join(path, "meta")).collect()[0]
    vocab = [(r["token"], int(r["id"]), r["kind"]) for r in
             spark.read.parquet(os.path.join(path, "vocab")).orderBy("id").collect()]
    merges = [(r["a"], r["b"], int(r["n"])) for r in
              spark.read.parquet(os.path.join(path, "merges")).orderBy("rank").collect()]
    ids = [i for _, i, _ in vocab]
    if ids != list(range(len(ids))):
        raise ValueError("vocabulary ids are not dense 0..V-1")
    return BpeModel(merges=merges, vocab=vocab, specials=list(meta["specials"] or []),
                    mode=meta["mode"], lowercase=bool(meta["lowercase"]),
                    byte_fallback=bool(meta["byte_fallback"]), vocab_size=int(meta["vocab_size"]),
                    min_freq=int(meta["min_freq"]), stop_reason=meta["stop_reason"] or "")


# --- byte-level unicode alphabet (word-mode artefacts) ------------------------
def byte_alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes map to themselves; the other 68 bytes map, in
    byte order, to code points 256, 257, … (the public byte-level rule)."""
    keep = (list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1))
            + list(range(ord("®"), ord("ÿ") + 1)))
    out, extra = {}, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def _to_alphabet(hex_surface: str, table: dict[int, str]) -> str:
    return "".join(table[b] for b in bytes.fromhex(hex_surface))


def _from_alphabet(s: str, inv: dict[str, int]) -> str:
    return bytes(inv[ch] for ch in s).hex().upper()


def save_word_artifacts(spark: SparkSession, model: BpeModel, out_dir: str) -> None:
    """A8 save: ``vocab.json`` (one JSON object) and ``merges.txt`` (rank order)."""
    table = byte_alphabet()
    vocab = {(t if k == "special" else _to_alphabet(t, table)): i for t, i, k in model.vocab}
    vdf = spark.createDataFrame([(vocab,)], "v map<string,int>")
    vdf.select(F.to_json("v").alias("value")).coalesce(1).write.mode("overwrite") \
        .text(os.path.join(out_dir, "vocab.json"))
    rows = [("#version: 0.2",)] + [(f"{_to_alphabet(a, table)} {_to_alphabet(b, table)}",)
                                    for a, b, _ in model.merges]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite") \
        .text(os.path.join(out_dir, "merges.txt"))


def load_word_artifacts(spark: SparkSession, vocab_path: str, merges_path: str,
                        specials: list[str] | None = None) -> BpeModel:
    """A8 load: ``from_json`` + ``explode`` for the vocabulary; line order = rank."""
    inv = {ch: b for b, ch in byte_alphabet().items()}
    vj = spark.read.text(vocab_path).select(
        F.explode(F.from_json("value", "map<string,int>")).alias("token", "id")).collect()
    ml = read_text_lines(spark, merges_path).orderBy("file_ord", "file", "block", "row") \
        .select("line").collect()
    pairs = [r["line"].split(" ") for r in ml if r["line"] and not r["line"].startswith("#version")]
    merges = [(_from_alphabet(a, inv), _from_alphabet(b, inv), 0) for a, b in pairs]
    # What is neither one byte nor the result of a merge is a special.
    made = {a + b for a, b in pairs} - set(specials or [])
    vocab = []
    for r in sorted(vj, key=lambda r: r["id"]):
        tok = r["token"]
        kind = "merge" if tok in made else "byte" if len(tok) == 1 and tok in inv else "special"
        vocab.append((tok if kind == "special" else _from_alphabet(tok, inv), int(r["id"]), kind))
    if [i for _, i, _ in vocab] != list(range(len(vocab))):
        raise ValueError("vocabulary ids are not dense 0..V-1")
    specials = [t for t, _, k in vocab if k == "special"]
    return BpeModel(merges=merges, vocab=vocab, specials=specials, mode="word",
                    vocab_size=len(vocab))
