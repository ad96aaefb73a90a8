"""Operator 4: token ids in patched frame-of-reference blocks.

Documents are range-partitioned by key and sorted; inside a partition their
ids (each document closed by an end id) are gathered into segments of whole
documents.  A segment is self-contained: a header, an index of block starts,
and blocks of ``BLOCK`` ids.  A block stores its minimum, a bit width that
covers ``PERCENTILE`` of its offsets, the offsets packed at that width, and an
exception list (place, value) of those that do not fit.

Segments are written as rows of a table (payload beside the documents it
holds) through Spark's committer, so a lost executor leaves no torn file, and
any store that Spark reaches serves as the sink.

Layout, little-endian: magic ``PFR1``; uint32 blocks; uint64 ids; uint64 block
starts (from the first block, with a last one past the end); then per block
uint32 minimum, uint8 width, uint16 ids, uint16 exceptions, the packed bytes,
the uint16 places and the uint32 offsets of the exceptions.

Defined cases: null and empty texts are the end id alone; null keys come first;
rows with one key are ordered by a hash of their text; a document longer than a
segment has a segment of its own; an empty table writes no segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .bpe_ids import default_vocabulary, encoder
from .common import range_parts, text_or_empty

BLOCK, PERCENTILE, SEGMENT_IDS, END_ID = 1024, 0.95, 1 << 18, 0
MAGIC = b"PFR1"
SEGMENTS = ("part int, seg long, n_ids long, keys array<bigint>, lengths array<bigint>, "
            "payload binary")


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits needed for each value."""
    return np.where(v > 0, np.floor(np.log2(np.maximum(v, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, each row packed at ``width`` bits, lowest bit first."""
    if width == 0 or not len(v):
        return np.zeros((len(v), 0), np.uint8)
    bits = ((v[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(v), -1), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(rows), n), np.uint32)
    bits = np.unpackbits(rows, axis=1, count=n * width, bitorder="little").reshape(len(rows), n, width)
    whole = np.zeros((len(rows), n, 32), np.uint8)
    whole[:, :, :width] = bits
    return np.packbits(whole.reshape(len(rows), -1), axis=1, bitorder="little").view("<u4").reshape(len(rows), n)


def write_segment(ids: np.ndarray) -> bytes:
    """One segment's payload."""
    ids = np.asarray(ids, np.uint32)
    n_blocks = -(-len(ids) // BLOCK)
    full = len(ids) // BLOCK
    blocks: list[bytes] = [b""] * n_blocks
    for rows, first in ((ids[: full * BLOCK].reshape(full, BLOCK), 0),
                        (ids[full * BLOCK:].reshape(1, -1), full)):
        if not rows.size:
            continue
        low = rows.min(axis=1)
        off = rows - low[:, None]
        need = np.sort(_bits(off), axis=1)
        n = rows.shape[1]
        width = need[:, min(n - 1, int(np.ceil(PERCENTILE * n)) - 1)]
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            packed = _pack(off[at] & np.uint32((1 << int(w)) - 1), int(w))
            over = off[at].astype(np.uint64) >> np.uint64(w) > 0
            for j, i in enumerate(at):
                places = np.flatnonzero(over[j])
                blocks[first + i] = (
                    struct.pack("<IBHH", int(low[i]), int(w), n, len(places)) + packed[j].tobytes()
                    + places.astype("<u2").tobytes() + off[i][places].astype("<u4").tobytes())
    starts = np.cumsum([0] + [len(b) for b in blocks]).astype("<u8")
    return MAGIC + struct.pack("<IQ", n_blocks, len(ids)) + starts.tobytes() + b"".join(blocks)


def read_block(payload: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by the index."""
    n_blocks, _ = struct.unpack_from("<IQ", payload, 4)
    starts = np.frombuffer(payload, "<u8", n_blocks + 1, 16)
    at = 16 + 8 * (n_blocks + 1) + int(starts[block])
    low, width, n, n_over = struct.unpack_from("<IBHH", payload, at)
    size = -(-n * width // 8)
    rows = np.frombuffer(payload, np.uint8, size, at + 9).reshape(1, -1)
    off = _unpack(rows, width, n)[0].copy()
    places = np.frombuffer(payload, "<u2", n_over, at + 9 + size)
    off[places] = np.frombuffer(payload, "<u4", n_over, at + 9 + size + 2 * n_over)
    return off + np.uint32(low)


def read_segment(payload: bytes) -> np.ndarray:
    """All ids of a segment."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment")
    n_blocks, n_ids = struct.unpack_from("<IQ", payload, 4)
    out = [read_block(payload, b) for b in range(n_blocks)]
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    if len(ids) != n_ids:
        raise ValueError("segment is torn")
    return ids


def _write(vocabulary: str, end_id: int):
    def run(batches):
        enc, part, seg = encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys, lengths, parts, held = [], [], [], 0

        def segment():
            nonlocal seg, keys, lengths, parts, held
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seg], pa.int64()), pa.array([held], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([write_segment(np.concatenate(parts))], pa.binary())],
                names=["part", "seg", "n_ids", "keys", "lengths", "payload"])
            seg, keys, lengths, parts, held = seg + 1, [], [], [], 0
            return row

        for b in batches:
            for key, text in zip(b.column("key"), b.column("text"), strict=True):
                ids = np.append(np.frombuffer(enc.encode(text.as_py()), enc.dtype).astype(np.uint32),
                                np.uint32(end_id))
                if held and held + len(ids) > SEGMENT_IDS:
                    yield segment()
                keys.append(key.as_py())
                lengths.append(len(ids))
                parts.append(ids)
                held += len(ids)
        if held:
            yield segment()
    return run


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
              vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode, order by key and write the segments to ``path``."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")) \
        .withColumn("_h", F.xxhash64("text"))
    ranged = d.repartitionByRange(range_parts(docs), "key", "_h").sortWithinPartitions("key", "_h")
    ranged.select("key", "text").mapInArrow(_write(vocabulary or default_vocabulary(), end_id), SEGMENTS) \
        .write.option("compression", "none").parquet(path)


def _read(batches):
    for b in batches:
        out = {"part": [], "seg": [], "key": [], "at": [], "n_tokens": [], "ids_crc32": []}
        for row in b.to_pylist():
            ids = read_segment(row["payload"]).astype("<u4")
            at = 0
            for key, n in zip(row["keys"], row["lengths"], strict=True):
                for k, v in (("part", row["part"]), ("seg", row["seg"]), ("key", key), ("at", at),
                             ("n_tokens", n), ("ids_crc32", zlib.crc32(ids[at: at + n].tobytes()))):
                    out[k].append(v)
                at += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, pa.int32() if k == "part" else pa.int64()) for k, v in out.items()],
            names=list(out))


def read_digests(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32.

    Segment bases come from the segments' id counts: inside a part (few
    segments), and over parts (one row each).
    """
    sizes = segments.select("part", "seg", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))) \
        .join(base, "part").select("part", "seg", (F.col("base") + F.col("before")).alias("base"))
    rows = segments.select("part", "seg", "keys", "lengths", "payload").mapInArrow(
        _read, "part int, seg long, key long, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "seg"]).select(
        F.col("key").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text",
               vocabulary: str | None = None) -> DataFrame:
    """Write to the shared folder, read back, and digest what was read."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_ids(docs, path, key, text, vocabulary)
    return read_digests(spark.read.schema(SEGMENTS).parquet(path), key)
