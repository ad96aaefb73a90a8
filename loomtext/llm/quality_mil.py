"""Operator 6: quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is
encoded (shares of character classes, repetition, word lengths, then a learned
layer), gated attention weighs the passages, and the weighted sum is
scored.  Only document labels train it: encoder, attention and scorer together,
by gradient descent over a bounded sample of the labelled training rows.

The sample is the ``SAMPLE`` training rows with the least hash of their key,
without documents of more than ``MAX_PASSAGES`` passages.  Scoring covers all
passages of all documents; inputs are the text alone.

Defined cases: null and empty texts are one passage without characters; a null
key is held out (CRC of no text); conflicting labels of a key count as the best
of them; labels without a quality are left out; without labels of both kinds
every score is the share of good labels (0.5 without any); an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import as_given, aside, set_aside, text_or_empty
from .text_hash import buffers, words_at

PASSAGE_WORDS, HIDDEN, GATES = 40, 16, 8
SAMPLE, MAX_PASSAGES, ROUNDS, RATE, DECAY = 4000, 2000, 250, 0.03, 1e-4
THRESHOLD, FOLDS = 0.3, 5
#: Texts encoded at a time.
STEP = 128

#: Character classes: fixed values. Bytes in none of them are "other symbols".
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c",
            bytes(range(128, 256)), b".,;:?", b"!", b"'\"`-", b"()[]{}<>", b"|/\\", b"#$%&*@^~+=_"]
N_CLASS = len(_CLASSES) + 1
_CLASS = np.full(256, N_CLASS - 1, np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_LETTER = np.isin(_CLASS, (0, 1, 4))
FEATURES = N_CLASS + 5


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(raw features of each passage, first passage of each text and the total)."""
    raw, offsets = buffers(column)
    words, bounds, at = words_at(raw, offsets)
    n_words = np.diff(bounds)
    n_pass = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    first = np.concatenate([[0], np.cumsum(n_pass)])
    out = np.zeros((int(first[-1]), FEATURES))
    if not len(words):
        return out, first
    doc = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(words)) - bounds[:-1][doc]
    passage = first[:-1][doc] + place // PASSAGE_WORDS
    # Bytes from the first word on belong to the passage of the word before them.
    of_byte = np.repeat(passage, np.diff(np.append(at, len(raw))))
    cls = _CLASS[raw[at[0]:]]
    counts = np.bincount(of_byte * N_CLASS + cls, minlength=len(out) * N_CLASS).reshape(-1, N_CLASS)
    out[:, :N_CLASS] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    held = np.bincount(passage, minlength=len(out))
    some = np.maximum(held, 1)
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((words, passage))
    new = np.ones(len(words))
    new[1:] = (words[order][1:] != words[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    letters = np.add.reduceat(_LETTER[raw].astype(np.int64), at)
    size = np.add.reduceat((_CLASS[raw] != 3).astype(np.int64), at)
    for i, v in enumerate((again, new, letters == 0, np.minimum(size, 40) / 10)):
        per = np.zeros(len(words))
        per[:] = v
        by = passage[order] if i == 1 else passage
        out[:, N_CLASS + i] = np.bincount(by, weights=per, minlength=len(out)) / some
    out[:, N_CLASS + 4] = held == 0
    return out, first


class Model:
    """Weights; ``forward`` scores bags of passages."""

    def __init__(self, weights: dict[str, np.ndarray], prior: float, constant: bool):
        self.w, self.prior, self.constant = weights, prior, constant

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        z = (x - w["mean"]) / w["deviation"]
        h = np.tanh(z @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (t * s) @ w["a"]
        starts, n = first[:-1], np.diff(first)
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), n))
        p = e / np.repeat(np.add.reduceat(e, starts), n)
        bag = np.add.reduceat(p[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(bag @ w["c"] + w["d"], -30, 30)))
        return {"z": z, "h": h, "t": t, "s": s, "p": p, "bag": bag, "score": score}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(first) - 1, self.prior)
        return self.forward(x, first)["score"]


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
    """Adam on the log-loss of whole bags; passes gradients through the attention."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or prior in (0.0, 1.0):
        return Model({}, prior, True)
    rng = np.random.default_rng(6)
    w = {"mean": x.mean(axis=0), "deviation": x.std(axis=0) + 1e-3,
         "W": rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), "b": np.zeros(HIDDEN),
         "V": rng.standard_normal((HIDDEN, GATES)) / 4, "U": rng.standard_normal((HIDDEN, GATES)) / 4,
         "a": rng.standard_normal(GATES) / 4, "c": rng.standard_normal(HIDDEN) / 4, "d": np.zeros(1)}
    model = Model(w, prior, False)
    names = [k for k in w if k not in ("mean", "deviation")]
    m1 = {k: np.zeros_like(w[k]) for k in names}
    m2 = {k: np.zeros_like(w[k]) for k in names}
    n = np.diff(first)
    for step in range(1, ROUNDS + 1):
        f = model.forward(x, first)
        d_logit = (f["score"] - y) / len(y)
        d_bag = np.repeat(d_logit[:, None] * w["c"], n, axis=0)
        d_p = (d_bag * f["h"]).sum(axis=1)
        d_a = f["p"] * (d_p - np.repeat(np.add.reduceat(f["p"] * d_p, first[:-1]), n))
        d_t = d_a[:, None] * w["a"] * f["s"] * (1 - f["t"] ** 2)
        d_s = d_a[:, None] * w["a"] * f["t"] * f["s"] * (1 - f["s"])
        d_h = d_bag * f["p"][:, None] + d_t @ w["V"].T + d_s @ w["U"].T
        d_in = d_h * (1 - f["h"] ** 2)
        grad = {"W": f["z"].T @ d_in, "b": d_in.sum(axis=0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_s,
                "a": (f["t"] * f["s"]).T @ d_a, "c": f["bag"].T @ d_logit, "d": d_logit.sum(keepdims=True)}
        for k in names:
            g = grad[k] + DECAY * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo ``FOLDS``; 0 is held out."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % FOLDS


def _encode(batches):
    for batch in batches:
        for b in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
            x, first = passages(b.column("text"))
            yield pa.RecordBatch.from_arrays([
                b.column("rank"), b.column("quality"),
                pa.array([x[s:e].astype(np.float32).ravel() if e - s <= MAX_PASSAGES else None
                          for s, e in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.float32()))],
                names=["rank", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of the rows outside the held-out fold."""
    ship_package(docs.sparkSession)
    chosen = labels.select(F.col(key).alias("_lk"), F.col("quality").cast("int").alias("quality")) \
        .where(F.col("_lk").isNotNull() & F.col("quality").isin(0, 1) & (fold("_lk") != 0)) \
        .groupBy("_lk").agg(F.max("quality").alias("quality")) \
        .withColumn("rank", F.xxhash64("_lk")).orderBy("rank", "_lk").limit(SAMPLE)
    d = docs.select(F.col(key).alias("_dk"), text_or_empty(text).alias("text"))
    rows = d.join(F.broadcast(chosen), F.col("_dk") == F.col("_lk")).select("rank", "quality", "text") \
        .mapInArrow(_encode, "rank long, quality int, x array<float>") \
        .where("x is not null").orderBy("rank").limit(SAMPLE).collect()
    bags = [np.asarray(r.x).reshape(-1, FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return fit(np.concatenate(bags) if bags else np.zeros((0, FEATURES)), first,
               np.asarray([r.quality for r in rows], float))


def _score(model: Model, names: list[str]):
    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                score = model.score(*passages(b.column("_text")))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(score, pa.float64())],
                                                 names=[*names, "_score"])
    return run


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_score``."""
    ship_package(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])
    return docs.withColumn("_text", text_or_empty(text)).mapInArrow(_score(model, docs.columns), schema)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """Per document: key, held_out, score, predicted."""
    model = train(docs, labels, key, text)
    return with_score(docs.select(key, text), model, text).select(
        key, (fold(key) == 0).alias("held_out"), F.col("_score").alias("score"),
        F.when(F.col("_score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    model = train(docs, labels, key, text)
    rows = with_score(set_aside(docs), model, aside(docs, text))
    return as_given(rows.where(F.col("_score") >= threshold), docs)
