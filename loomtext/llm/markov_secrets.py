"""Operator 5: secrets by character Markov models.

Base spans follow fixed rules (assign, access, hex) and always stand.  Two
first-order models over characters are trained: one of random strings, from the
values of base spans, one of ordinary identifiers, from the corpus' longer runs of
letters and joiners without a digit or plus sign, and from runs of digits alone
(numbers are no secrets).  Those rules label the samples;
the counts cover all documents and are small matrices, summed by Spark.  A long
run outside base spans whose log-likelihood ratio per character is at least
``RATIO`` is added as ``random``.

Defined cases: null and empty texts have no spans; without base spans there is
no random model and nothing is added; repeated rows are separate; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import text_or_empty
from .spans import apart, union
from .text_hash import buffers

KINDS = ("assign", "access", "hex")
#: Runs that train the identifier model, and runs that are scored.
LEARN_CHARS, SCORE_CHARS, RATIO = 8, 16, 1.0
#: Weight of a model's character shares in each row of its transitions.
SMOOTH = 20.0
STEP = 256

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SCORE_CHARS},}}")
KEYWORDS = r"(?i)passw|secret|token|api_?key"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET)
_CODE = np.full(256, -1, np.int64)
_CODE[list(ALPHABET.encode())] = np.arange(N)
_ODD = np.isin(np.arange(256), list(b"0123456789+"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) by start, then kind as listed."""
    out = [("assign", *m.span(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", *m.span(), m.start()) for m in _ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [("hex", *m.span(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def transitions(values: list[str]) -> np.ndarray:
    """Counts of neighbouring characters."""
    out = np.zeros((N, N), np.int64)
    for v in values:
        c = _CODE[np.frombuffer(v.encode("latin-1", "replace"), np.uint8)]
        ok = (c[1:] >= 0) & (c[:-1] >= 0)
        np.add.at(out, (c[:-1][ok], c[1:][ok]), 1)
    return out


def _runs(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of the alphabet, not across texts."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _CODE[raw] >= 0
    edge = inside[1:] != inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(inside[cut]) & (inside[cut + 1])] if len(cut) else cut  # a run goes on into the next text
    starts = np.flatnonzero(edge & inside[1:])
    ends = np.flatnonzero(edge & inside[:-1])
    starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def _count(batches):
    """Transition counts of one task: random strings (1), identifiers (0)."""
    total = np.zeros((2, N, N), np.int64)
    for batch in batches:
        for b in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
            raw, offsets = buffers(b.column("text"))
            if not len(raw):
                continue
            starts, ends = _runs(raw, offsets, LEARN_CHARS)
            odd, digits = (np.concatenate([[0], np.cumsum(m[raw])]) for m in (_ODD, _DIGIT))
            plain = (odd[starts] == odd[ends]) | (digits[ends] - digits[starts] == ends - starts)
            starts, ends = starts[plain], ends[plain]
            code = _CODE[raw]
            mark = np.zeros(len(raw) + 1, np.int64)
            mark[starts] += 1
            mark[ends] -= 1
            within = np.cumsum(mark[:-1]) > 0
            first = np.zeros(len(raw), bool)
            first[starts] = True
            pair = within[1:] & ~first[1:]
            total[0] += np.bincount(code[:-1][pair] * N + code[1:][pair], minlength=N * N).reshape(N, N)
            long = np.zeros(b.num_rows, bool)
            at, _ = _runs(raw, offsets, SCORE_CHARS)
            long[np.searchsorted(offsets, at, "right") - 1] = True
            for i in np.flatnonzero(long | np.asarray(b.column("named"))):
                text = b.column("text")[int(i)].as_py()
                total[1] += transitions([text[v:e] for _, _, e, v in base_spans(text)])
    m, a, z = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(a, pa.int32()), pa.array(z, pa.int32()),
                                      pa.array(total[m, a, z], pa.int64())], names=["model", "a", "z", "n"])


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log P(z | a) of random strings less that of identifiers, smoothed by P(z)."""
    share = counts.sum(axis=1, keepdims=True) + 0.5
    share = share / share.sum(axis=2, keepdims=True)
    p = (counts + SMOOTH * share) / (counts.sum(axis=2, keepdims=True) + SMOOTH)
    return np.log(p[1]) - np.log(p[0])


def _texts(docs: DataFrame, text: str, *cols) -> DataFrame:
    t = text_or_empty(text)
    return docs.select(*cols, t.alias("text"), t.rlike(KEYWORDS).alias("named"))


def train(docs: DataFrame, text: str = "text") -> np.ndarray | None:
    """The log-ratio matrix; None without any base span."""
    counts = np.zeros((2, N, N))
    rows = _texts(docs, text).mapInArrow(_count, "model int, a int, z int, n long") \
        .groupBy("model", "a", "z").agg(F.sum("n").alias("n")).collect()  # at most 2 x 67 x 67
    for r in rows:
        counts[r.model, r.a, r.z] = r.n
    return log_ratio(counts) if counts[1].any() else None


def random_runs(text: str, base: list[tuple[str, int, int, int]], ratio: np.ndarray) -> list[tuple[str, int, int]]:
    """Long runs apart from base spans that look random."""
    out = []
    for s, e in apart((m.span() for m in _RUN.finditer(text)), union((a, b) for _, a, b, _ in base)):
        c = _CODE[np.frombuffer(text[s:e].encode(), np.uint8)]
        if ratio[c[:-1], c[1:]].mean() >= RATIO:
            out.append(("random", s, e))
    return out


def _find(ratio: np.ndarray | None):
    order = (*KINDS, "random")
    none = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")

    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                raw, offsets = buffers(b.column("text"))
                long = np.zeros(b.num_rows + 1, bool)
                if len(raw):
                    at, _ = _runs(raw, offsets, SCORE_CHARS)
                    long[np.searchsorted(offsets, at, "right") - 1] = True
                look = long[:-1] | np.asarray(b.column("named"))
                out = [none] * b.num_rows
                for i in np.flatnonzero(look):
                    text = b.column("text")[int(i)].as_py()
                    base = base_spans(text)
                    more = random_runs(text, base, ratio) if ratio is not None else []
                    told = [f"{k}:{s}:{e}" for k, s, e, _ in base]
                    all_ = sorted([s[:3] for s in base] + more, key=lambda s: (s[1], order.index(s[0])))
                    out[i] = (*(sum(s[0] == k for s in base) for k in KINDS), len(more),
                              hashlib.sha256(",".join(told).encode()).hexdigest(),
                              ",".join(f"{k}:{s}:{e}" for k, s, e in all_))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), *(pa.array(c, pa.int64()) for c in cols[:4]),
                     *(pa.array(c, pa.string()) for c in cols[4:])],
                    names=["key", *(f"n_{k}" for k in KINDS), "n_random", "base_sha256", "spans"])
    return run


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, counts of base spans, n_random, base_sha256, spans."""
    ship_package(docs.sparkSession)
    ratio = train(docs, text)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return _texts(docs, text, F.col(key).cast("long").alias("key")).mapInArrow(
        _find(ratio), f"key long, {counts}, n_random long, base_sha256 string, spans string") \
        .withColumnRenamed("key", key)
