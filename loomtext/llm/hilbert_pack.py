"""Operator 8: packing along a space-filling curve.

A document's token ids are hashed into a signed vector, which is normalised
and projected to ``DIMS`` numbers.  Their ranks in a normal law with the
corpus' mean and deviation are the coordinates of a Hilbert curve; documents
are range-sorted by (curve key, document key), so that neighbours on the curve
are alike, and their ids fill sequences of ``LENGTH`` one after the other.
Documents are cut where a sequence ends, so only the very last one is padded.

Defined cases: null and empty texts are the end id alone; null keys and
repeated rows are packed like any others; an empty table gives no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import exclusive_prefix_sum
from ..session import ship_package
from .bpe_ids import default_vocabulary, encoder
from .common import materialize, range_parts, text_or_empty

LENGTH, END_ID, DIMS, BITS, HASHED = 2048, 1, 4, 10, 256
PIECES = ("{key} long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
#: Documents encoded and projected at a time.
STEP = 256


def document_vectors(ids: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Signed hashed counts of each document, square-rooted, normalised, projected."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (h >> np.uint64(56)).astype(np.int64) % HASHED
    sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    v = np.bincount(docs * HASHED + bucket, weights=sign, minlength=n * HASHED).reshape(n, HASHED)
    v = np.sign(v) * np.sqrt(np.abs(v))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v @ np.random.default_rng(8).standard_normal((HASHED, DIMS))


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows of ``cells``).

    Each level of the curve, from the coarsest, reflects or swaps the finer
    bits of the axes; the Gray code of what remains, read across the axes, is
    the key.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level) & 1
    return key


def _encode(vocabulary: str, end_id: int):
    def run(batches):
        enc = encoder(vocabulary)
        end = np.asarray([end_id], enc.dtype).tobytes()
        for batch in batches:
            for b in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                ids = [enc.encode(t) + end for t in b.column("text").to_pylist()]
                n = np.asarray([len(x) // enc.dtype.itemsize for x in ids])
                v = document_vectors(np.frombuffer(b"".join(ids), enc.dtype),
                                     np.repeat(np.arange(len(ids)), n), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [b.column("_rid"), b.column("key"), pa.array(n, pa.int64()),
                     *(pa.array(v[:, i]) for i in range(DIMS)), pa.array(ids, pa.binary())],
                    names=["_rid", "key", "n_tokens", *(f"v{i}" for i in range(DIMS)), "ids"])
    return run


def _curve(mean: list[float], deviation: list[float]):
    def run(batches):
        for b in batches:
            v = np.stack([b.column(f"v{i}").to_numpy() for i in range(DIMS)], axis=1)
            z = (v - mean) / np.maximum(deviation, 1e-12)
            share = 1 / (1 + np.exp(-1.702 * np.clip(z, -8, 8)))  # close to the normal law
            cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("_rid"), b.column("key"), b.column("n_tokens"), pa.array(hilbert_key(cells))],
                names=["_rid", "key", "n_tokens", "curve"])
    return run


def _cut(itemsize: int, length: int, names: list[str]):
    def run(batches):
        for b in batches:
            out = [[] for _ in names]
            for key, n, at, ids in zip(*(b.column(c).to_pylist() for c in ("key", "n_tokens", "at", "ids")),
                                       strict=True):
                ids = np.frombuffer(ids, f"<u{itemsize}").astype("<u4")
                done = 0
                while done < n:
                    offset = (at + done) % length
                    size = min(n - done, length - offset)
                    for o, v in zip(out, (key, done, size, zlib.crc32(ids[done: done + size].tobytes()), n,
                                          (at + done) // length, offset), strict=True):
                        o.append(v)
                    done += size
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)
    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
         length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it starts in its document and in its sequence."""
    ship_package(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    d = docs.select(F.monotonically_increasing_id().alias("_rid"),
                    F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    dims = ", ".join(f"v{i} double" for i in range(DIMS))
    table = materialize(d.mapInArrow(
        _encode(vocabulary, end_id), f"_rid long, key long, n_tokens long, {dims}, ids binary"), "encoded")
    law = table.agg(*(f(F.col(f"v{i}")) for i in range(DIMS) for f in (F.avg, F.stddev_pop))).first()
    law = [x or 0.0 for x in law]
    placed = table.select("_rid", "key", "n_tokens", *(f"v{i}" for i in range(DIMS))).mapInArrow(
        _curve(law[::2], law[1::2]), "_rid long, key long, n_tokens long, curve long")
    at = exclusive_prefix_sum(placed, "n_tokens", ["curve", "key", "_rid"], out_col="at",
                              blocks=range_parts(docs)).select("_rid", "at")
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return table.select("_rid", "key", "n_tokens", "ids").join(at, "_rid") \
        .select("key", "n_tokens", "at", "ids") \
        .mapInArrow(_cut(encoder(vocabulary).dtype.itemsize, length, names), PIECES.format(key=key))
