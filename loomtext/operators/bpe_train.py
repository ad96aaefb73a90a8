"""The merge loop of BPE training, many merges a round.

State: distinct sequences ``(ord, w, ids)`` (their place in corpus order, weight, token
ids as packed bytes) and the pair counts ``(a, b, n)``, kept by delta.  One merge a pass over the corpus
would need 32,000 passes; a round here learns all merges above a count at once:

1. the *hot* pairs are those that occur more than ``floor`` times, ``floor`` being the
   count of the first pair left out (the hot set is bounded by ``hot``);
2. every sequence is cut into its runs of hot pairs, and equal runs are added up
   across the corpus (a shuffle of distinct runs), with the place where each first occurs;
3. the merges are learned on the distinct runs, one after another by the loop's own rule,
   while the best pair occurs more than ``floor`` times.  This is exact: a new pair
   (x, ab) occurs at most as often as (x, a), so one that matters lies inside a run;
4. one pass applies the merges to the sequences and gives the counts' delta.

Only pairs that occur at least 1 / ``SPAN`` as often as the best are counted, and the rounds
work on the distinct runs of these pairs, a small part of the sequences.  That is exact too:
the occurrences of a pair all come to be in the round that makes the later of its tokens,
and become fewer from then on, and by step 3 no pair that could be counted leaves its run.
When no counted pair is left, one pass over the sequences applies the merges and counts
again, and a second one cuts the next runs.

The distinct runs are fetched only below ``RUNS`` rows and ``RUN_TOKENS`` tokens, measured
first; otherwise the hot set shrinks, down to one pair (one merge a round), and its runs are
cut out of the distinct ones without another pass over the sequences.  When more
pairs tie for the first place than fit the hot set, those that come first are hot, runs are
made of all pairs that tie, and only runs with a hot one are fetched.  Beyond ``TIED`` tied
pairs, runs get one more token on each side instead, and a pair that touches such a
token and could come next ends the round.

Merges are appended to ``log`` (a folder of one small Parquet table a round) before they
are applied.  Training that finds a log replays its merges and goes on from there.
"""

from __future__ import annotations

import heapq
import logging
from array import array
from bisect import bisect_right
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import cut_lineage, ship_package, uncut
from . import kernels as K
from .positions import range_blocks

log_ = logging.getLogger(__name__)

#: Hot pairs of a round: at first, and at most.
HOT, MAX_HOT = 16, 16384
#: Bounds of the distinct runs that one round fetches.
RUNS, RUN_TOKENS = 150_000, 2_000_000
#: Tied pairs that a round may broadcast (8 bytes each).
TIED = 1 << 20
#: Pairs are counted that occur at least 1 / SPAN as often as the best; of at most KNOWN
#: such pairs the tasks know which they are.
SPAN, KNOWN = 4, 1 << 18

#: Tokens that a pass holds at a time (one sequence may hold more).
CHUNK = 1 << 21
#: Times that a pair is sorted instead of being weighed.
FEW = 4
#: Pair codes that a chunk may count in a table of its own.
DENSE = 1 << 22

#: ``pos`` is the place of a sequence's first token in the sequence ``ord`` it is cut from.
_STATE = "ord long, pos long, w long, ids binary"
_NAMES = ["ord", "pos", "w", "ids"]


# ---------------------------------------------------------------------------
# passes over the sequences
# ---------------------------------------------------------------------------
def _chunks(batch, kind: str):
    """(ord, pos, w, ids, offsets) of a batch, in chunks of whole sequences."""
    col = batch.column("ids").cast(pa.large_binary())
    _, ends, data = col.buffers()
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(ends, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    tokens = raw[offsets[0]:offsets[-1]].view(kind)
    offsets = (offsets - offsets[0]) // size
    order, pos, w = (np.asarray(batch.column(c), np.int64) for c in _NAMES[:3])
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        yield order[lo:hi], pos[lo:hi], w[lo:hi], tokens[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def _kind(width: int) -> str:
    return "<u2" if width <= 1 << 16 else "<i4"


def _blobs(ids, offsets, kind: str) -> pa.Array:
    raw = ids.astype(kind)
    ends = (offsets * raw.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())]
    ).cast(pa.binary())


def _pair_sums(ids, offsets, weights, width, at, places=True):
    """Pairs that start at ``at`` (a mask of neighbours, or places): (keys, sums of weights,
    first position in the chunk, if ``places``)."""
    left, right = ids[:-1][at].astype(np.int64), ids[1:][at]
    if not len(left):
        return (np.zeros(0, np.int64),) * 3
    at = np.flatnonzero(at) if places and at.dtype == bool else at
    w = None if (weights == 1).all() else np.repeat(weights, np.diff(offsets))[:-1][at]
    used = np.zeros(width, bool)
    used[left] = used[right] = True
    names = np.flatnonzero(used)
    m = len(names)
    if m * m <= min(DENSE, max(8 * len(left), 1 << 16)):
        code = np.cumsum(used) - 1
        pair = code[left] * m + code[right]
        sums = np.bincount(pair, minlength=m * m)
        seen = np.flatnonzero(sums)
        if w is not None:
            sums = np.zeros(m * m, np.int64)
            np.add.at(sums, pair, w)
        first = np.zeros(m * m, np.int64)
        if places:
            first[pair[::-1]] = at[::-1]
        return names[seen // m] * width + names[seen % m], sums[seen], first[seen]
    left *= width
    left += right
    if not places:  # most sequences occur few times, and sorting without weights is much faster
        many = None if w is None else w > FEW
        once = left if w is None else np.repeat(left[~many], w[~many])
        once = np.sort(once.astype(np.uint32) if width <= 1 << 16 else once)
        new = np.flatnonzero(np.concatenate([[len(once) > 0], once[1:] != once[:-1]]))
        found = once[new].astype(np.int64), np.diff(new, append=len(once))
        return (*(found if w is None else _summed([found, (left[many], w[many])])), new)
    by = np.argsort(left, kind="stable")
    keys = left[by]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.diff(new, append=len(keys)) if w is None else np.add.reduceat(w[by], new)
    return keys[new], sums, at[by[new]]


def _summed(parts):
    """(keys, sums) of several tables, those that cancel out left out."""
    if len(parts) > 1:
        parts = [p for p in parts if len(p[0])] or parts[:1]
    keys, sums = (np.concatenate([p[i] for p in parts] + [np.zeros(0, np.int64)]) for i in (0, 1))
    by = np.argsort(keys)
    keys = keys[by]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else by
    sums = np.add.reduceat(sums[by], new) if len(keys) else sums
    left = np.flatnonzero(sums)
    return keys[new][left], sums[left]


class _Tally:
    """Sums of pairs, handed on as packed rows of ``_STATE`` (part, 0, -1, keys and sums)."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys, sums):
        self.parts.append((keys, sums))
        self.held += len(keys)
        if self.held > CHUNK:
            self.parts = [_summed(self.parts)]
            self.held = len(self.parts[0][0])
        if self.held > CHUNK // 2:
            yield from self.told()

    def told(self):
        keys, sums = _summed(self.parts)
        self.parts, self.held = [], 0
        if not len(keys):
            return
        part = _part(keys)
        by = np.argsort(part, kind="stable")
        part = part[by]
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        names = part[at]
        both = np.stack([keys[by], sums[by]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names.astype(np.int64)), pa.array(np.zeros(len(names), np.int64)), pa.array(
                np.full(len(names), -1)), _blobs(both, 2 * np.append(at, len(keys)), "<i8")], names=_NAMES)


def _part(keys):
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)


def _tallied(rows: DataFrame, width: int, least: int) -> DataFrame:
    """(a, b, n) of the rows of ``_Tally``: sums below 0 and from ``least``."""
    def sums(batches):
        parts, held, bound = [], 0, 4 * CHUNK
        for batch in batches:
            for blob in batch.column("ids"):
                both = np.frombuffer(blob.as_buffer(), "<i8").reshape(-1, 2)
                parts.append((both[:, 0], both[:, 1]))
                held += len(both)
                if held > bound:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    bound = max(bound, 2 * held)
        keys, n = _summed(parts)
        told = (n < 0) | (n >= least)
        for at in range(0, len(keys), CHUNK):
            k, m = keys[at:at + CHUNK][told[at:at + CHUNK]], n[at:at + CHUNK][told[at:at + CHUNK]]
            yield pa.RecordBatch.from_arrays([pa.array(k // width), pa.array(k % width), pa.array(m)], names=["a", "b", "n"])

    # parts of one number go to one task, however rows are dealt: no task sees half a pair
    return rows.select("ord", "ids").repartition("ord").mapInArrow(sums, "a long, b long, n long")


class Pending:
    """Sequences as written (tokens of numpy type ``kind``), and the merges learned since,
    applied on the way."""

    def __init__(self, table: DataFrame, triples: list, width: int, kind: str):
        self.table, self.triples, self.width, self.kind = table, triples, width, kind
        self.base = table  # the checkpoint that holds it

    def chunks(self):
        """A function of a task's batches: their chunks, with the merges learned since applied."""
        ship_package(self.table.sparkSession)
        table, width, kind = K.pair_table(self.triples, self.width), self.width, self.kind
        joins = K.join_keys(self.triples, width)

        def run(batches):
            for batch in batches:
                for order, pos, w, ids, offsets in _chunks(batch, kind):
                    if len(joins):
                        ids, offsets, _, _ = K.merge_runs(ids, offsets, table, joins, width)
                    yield order, pos, w, ids, offsets

        return run

    def read(self, fn, schema: str) -> DataFrame:
        """``fn(ord, pos, w, ids, offsets)`` gives the columns of ``schema`` for each chunk."""
        chunks, names = self.chunks(), [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            for chunk in chunks(batches):
                yield pa.RecordBatch.from_arrays(fn(*chunk), names=names)

        return self.table.mapInArrow(run, schema)

    def rewritten(self) -> Pending:
        """Sequences written with the merges applied; those of one token are done."""
        return self._written(lambda tally, w, ids, offsets: (ids, offsets, ()))[0]

    def counts_from(self, least: int) -> DataFrame:
        """(a, b, n): the pairs that occur ``least`` times or more."""
        chunks, width = self.chunks(), self.width

        def run(batches):
            tally = _Tally()
            for _, _, w, ids, offsets in chunks(batches):
                yield from tally.add(*_pair_sums(ids, offsets, w, width, K.inner(offsets, len(ids)), False)[:2])
            yield from tally.told()

        return _tallied(self.table.mapInArrow(run, _STATE), width, least)

    def counted(self, least: int) -> tuple[Pending, DataFrame]:
        """``rewritten``, and in the same pass (a, b, n): the pairs that occur ``least`` times
        or more."""
        width = self.width

        def fn(tally, w, ids, offsets):
            pairs = _pair_sums(ids, offsets, w, width, K.inner(offsets, len(ids)), False)
            return ids, offsets, tally.add(*pairs[:2])

        state, rows = self._written(fn)
        return state, _tallied(rows, width, least)

    def advanced(self, triples: list, least: int = 1, known: np.ndarray | None = None) -> tuple[Pending, DataFrame]:
        """``rewritten`` with ``triples`` on top, and in the same pass the ``delta`` of these.  Of
        pairs that come to be, those of at least ``least`` are told; of those that were there,
        the ones in ``known`` (sorted pair keys; all if None)."""
        change = _change(triples, self.width)

        def fn(tally, w, ids, offsets):
            ids, offsets, (keys, sums) = change(w, ids, offsets)
            if known is not None:
                told = (sums > 0) | K.lookup(known, keys)[0]
                keys, sums = keys[told], sums[told]
            return ids, offsets, tally.add(keys, sums)

        state, rows = self._written(fn)
        return state, _tallied(rows, self.width, least)

    def _written(self, fn) -> tuple[Pending, DataFrame]:
        """The sequences that ``fn(tally, w, ids, offsets)`` gives, and the rows of the tally."""
        chunks, kind = self.chunks(), _kind(self.width)

        def run(batches):
            tally = _Tally()
            for order, pos, w, ids, offsets in chunks(batches):
                ids, offsets, told = fn(tally, w, ids, offsets)
                yield from told
                long = np.diff(offsets) > 1
                if not long.all():
                    ids = ids[np.repeat(long, np.diff(offsets))]
                    offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[long])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[long]), pa.array(pos[long]), pa.array(w[long]), _blobs(ids, offsets, kind)],
                    names=_NAMES)
            yield from tally.told()

        both = cut_lineage(self.table.mapInArrow(run, _STATE))
        state = Pending(both.where("w >= 0"), [], self.width, kind)
        state.base = both
        return state, both.where("w < 0")

    def counts(self, places: bool = False) -> DataFrame:
        """(a, b, n): pair counts; with ``places`` also ``at``, the first occurrence as one number."""
        width = self.width

        def fn(order, pos, w, ids, offsets):
            if places:
                order, pos, w, ids, offsets = _by_place(order, pos, w, ids, offsets)
            keys, sums, first = _pair_sums(ids, offsets, w, width, K.inner(offsets, len(ids)), places)
            found = [pa.array(keys // width), pa.array(keys % width), pa.array(sums)]
            if places:
                row = np.searchsorted(offsets, first, "right") - 1
                found += [pa.array(order[row]), pa.array(pos[row] + first - offsets[row])]
            return found

        rows = self.read(fn, "a long, b long, n long" + (", ord long, pos long" if places else ""))
        extra = [F.min(_place("ord", "pos")).alias("at")] if places else []
        return rows.groupBy("a", "b").agg(F.sum("n").alias("n"), *extra)

    def delta(self, triples: list) -> DataFrame:
        """(a, b, n): by how much further merges change the pair counts.  Only neighbours
        of a run that merges are counted."""
        change, width = _change(triples, self.width), self.width

        def fn(order, pos, w, ids, offsets):
            keys, sums = change(w, ids, offsets)[2]
            return [pa.array(keys // width), pa.array(keys % width), pa.array(sums)]

        return self.read(fn, "a long, b long, n long")

    def cut(self, keys: np.ndarray) -> Pending:
        """The distinct runs of the pairs in ``keys`` as sequences.  While these pairs and what
        grows from them are all that is learned, they do for the whole corpus."""
        rows = cut_lineage(_sequences(self._runs(keys)))
        return Pending(rows, [], self.width, "<i4")

    def runs(self, hot: list[tuple[int, int]], around: np.ndarray | None = None, margin: bool = False) -> DataFrame:
        """(run, w, at): distinct runs of hot pairs, their weight and first place.

        With ``around`` (sorted pair keys) runs are made of those pairs, and kept where
        they hold a hot one.  With ``margin`` a run takes in its neighbours.  The first
        two bytes of a run say whether it starts and ends with such a neighbour.
        """
        return self._runs(hot, around, margin)

    def _runs(self, hot, around=None, margin=False) -> DataFrame:
        width, keys = self.width, _keys(hot, self.width)

        def fn(order, pos, w, ids, offsets):
            order, pos, w, ids, offsets = _by_place(order, pos, w, ids, offsets)
            mask = K.pair_mask(ids, offsets, keys, width)
            member = mask if around is None else K.pair_mask(ids, offsets, around, width)
            return _found_runs(order, w, pos, ids, offsets, member, mask, margin)

        return _distinct(self.read(fn, _FOUND))


_FOUND = "run binary, w long, ord long, pos long"


def _found_runs(order, w, base, ids, offsets, member, mask, margin=False):
    """Columns of ``_FOUND``: the runs of ``member`` pairs that hold a pair of ``mask``, equal
    ones as one row.  The sequences start at place (``order``, ``base``), in ascending order."""
    start, stop = K.runs_of(member)
    if mask is not member:
        hits = np.concatenate([[0], np.cumsum(mask)])
        held = hits[stop - 1] > hits[start]
        start, stop = start[held], stop[held]
    row = np.searchsorted(offsets, start, "right") - 1
    left = ((start > offsets[row]) & margin).astype(np.int64)
    right = ((stop < offsets[row + 1]) & margin).astype(np.int64)
    lengths = stop - start + left + right
    ends = np.concatenate([[0], np.cumsum(lengths)])
    if mask is member and not margin:
        tokens = K.run_tokens(ids, member)
    else:
        tokens = ids[np.repeat(start - left - ends[:-1], lengths) + np.arange(ends[-1])]
    first, group = K.equal_groups(tokens, lengths)
    if margin:
        _, first, group = np.unique(group * 4 + left * 2 + right, return_index=True, return_inverse=True)
    sums = np.bincount(group, minlength=len(first)) if (w == 1).all() else np.zeros(len(first), np.int64)
    if not (w == 1).all():
        np.add.at(sums, group, w[row])
    # two bytes of marks, then four a token
    tokens, ends = K.gather(tokens, ends, first)
    ends = 2 * ends + np.arange(len(ends))
    head = np.zeros(ends[-1], bool)
    head[ends[:-1]] = True
    halves = np.empty(len(head), "<u2")
    halves[head] = left[first] + 256 * right[first]
    halves[~head] = tokens.astype("<i4").view("<u2")
    return [_blobs(halves, ends, "<u2"), pa.array(sums, pa.int64()), pa.array(order[row[first]], pa.int64()),
            pa.array((base[row] + start - offsets[row])[first], pa.int64())]


def _change(triples: list, width: int):
    """A function that merges a chunk: (ids, offsets, (keys, sums) by which pairs change)."""
    table, joins = K.pair_table(triples, width), K.join_keys(triples, width)

    def near(w, ids, offsets, marked):
        at = np.flatnonzero((marked[:-1] | marked[1:]) & K.inner(offsets, len(ids)))
        return _pair_sums(ids, offsets, w, width, at, False)

    def change(w, ids, offsets):
        new_ids, new_offsets, changed, fresh = K.merge_runs(ids, offsets, table, joins, width)
        old, new = near(w, ids, offsets, changed), near(w, new_ids, new_offsets, fresh)
        return new_ids, new_offsets, _summed([(old[0], -old[1]), new[:2]])

    return change


def _distinct(found: DataFrame) -> DataFrame:
    return found.groupBy("run").agg(F.sum("w").alias("w"), F.min(_place("ord", "pos")).alias("at"))


def fewer_runs(runs: DataFrame, hot: list[tuple[int, int]], width: int) -> DataFrame:
    """The distinct runs of ``hot``, from those of more pairs (``Pending.runs`` without
    margins): each lies inside one of these, so the sequences are not read again."""
    return Pending(_sequences(runs), [], width, "<i4")._runs(hot)


def _keys(hot, width: int) -> np.ndarray:
    """Sorted pair keys of pairs (or of keys)."""
    return np.sort(hot if isinstance(hot, np.ndarray) else np.array([a * width + b for a, b in hot], np.int64))


def _sequences(runs: DataFrame) -> DataFrame:
    """Distinct runs (without margins) as rows of ``_STATE``."""
    return runs.select(
        F.expr(f"cast(at div {_SHIFT} as long)").alias("ord"), F.expr(f"cast(at % {_SHIFT} as long)").alias("pos"),
        "w", F.expr("substring(run, 3)").alias("ids"))


def _by_place(order, pos, w, ids, offsets):
    """The sequences in corpus order."""
    if (order[1:] > order[:-1]).all():
        return order, pos, w, ids, offsets
    by = np.lexsort((pos, order))
    return order[by], pos[by], w[by], *K.gather(ids, offsets, by)


#: A place in the corpus as one number, so that its minimum is a hash aggregate.
_SHIFT = 1 << 40


def _place(order: str, pos: str):
    return (F.col(order).cast("decimal(20,0)") * F.lit(_SHIFT).cast("decimal(14,0)")
            + F.col(pos)).cast("decimal(38,0)")


# ---------------------------------------------------------------------------
# the loop's rule on the distinct runs
# ---------------------------------------------------------------------------
class RunMerger:
    """Greedy merging over weighted runs, held as one linked list.

    ``rank(pair, place)`` orders pairs of one count.
    """

    def __init__(self, runs: list[tuple[bytes, int, int]], hot: set, rank):
        self.rank = rank
        # packed: eight bytes a number, not an object each
        self.token, self.after, self.before, self.weight, self.starts = (array("q") for _ in range(5))
        self.places: list[int] = []  # of each run's first token
        self.margin: set[int] = set()
        self.at: dict[tuple[int, int], set[int]] = {}
        for run, w, place in sorted(runs, key=lambda r: r[2]):
            left, right = run[0], run[1]
            tokens = np.frombuffer(run[2:], np.int32).tolist()
            start, n = len(self.token), len(tokens)
            self.token.extend(tokens)
            self.after.extend(range(start + 1, start + n))
            self.after.append(-1)
            self.before.append(-1)
            self.before.extend(range(start, start + n - 1))
            self.weight.extend(repeat(w, n))
            self.starts.append(start)
            self.places.append(place - left)
            if left:
                self.margin.add(start)
            if right:
                self.margin.add(start + n - 1)
            for i in range(start, start + n - 1):
                pair = (self.token[i], self.token[i + 1])
                if pair in hot:
                    self.at.setdefault(pair, set()).add(i)
        self.n = {p: sum(self.weight[i] for i in at) for p, at in self.at.items()}
        self.heap = [(-n, p) for p, n in self.n.items()]
        heapq.heapify(self.heap)
        self.level: list = []   # (rank, pair) of the pairs that tie at ``best``
        self.best = None

    def rank_of(self, pair):
        first = min(self.at[pair])
        run = bisect_right(self.starts, first) - 1
        return self.rank(pair, self.places[run] + first - self.starts[run])

    def pick(self):
        """(count, pair) that comes next; ranks are only looked up where pairs tie."""
        while self.level:
            pair = self.level[0][1]
            if self.n.get(pair) == self.best:
                return self.best, pair
            heapq.heappop(self.level)
        while self.heap:
            n, pair = heapq.heappop(self.heap)
            if self.n.get(pair) != -n:
                continue
            tied = {pair}
            while self.heap and self.heap[0][0] == n:
                other = heapq.heappop(self.heap)[1]
                if self.n.get(other) == -n:
                    tied.add(other)
            self.best = -n
            if len(tied) == 1:
                self.level = [(None, pair)]
            else:
                self.level = [(self.rank_of(p), p) for p in tied]
                heapq.heapify(self.level)
            return self.best, self.level[0][1]
        return None

    def touches_margin(self, pair) -> bool:
        return any(i in self.margin or self.after[i] in self.margin for i in self.at[pair])

    def merge(self, pair, new: int) -> bool:
        """Merge all of a pair; whether a pair that now ties for the first place reaches
        into a margin, where its fate is not known."""
        a, b = pair
        changed = set()

        def drop(i, p):
            at = self.at.get(p)
            if at and i in at:
                at.discard(i)
                self.n[p] -= self.weight[i]
                changed.add(p)

        def add(i, p):
            self.at.setdefault(p, set()).add(i)
            self.n[p] = self.n.get(p, 0) + self.weight[i]
            changed.add(p)

        for i in sorted(self.at[pair]):
            j = self.after[i]
            if self.token[i] != a or j < 0 or self.token[j] != b:
                continue
            left, right = self.before[i], self.after[j]
            if left >= 0:
                drop(left, (self.token[left], a))
            drop(i, pair)
            if right >= 0:
                drop(j, (b, self.token[right]))
            self.token[i], self.token[j] = new, -1
            self.after[i] = right
            if right >= 0:
                self.before[right] = i
                add(i, (new, self.token[right]))
            if left >= 0:
                add(left, (self.token[left], new))
        rivals = []
        for p in changed:
            n = self.n[p]
            if n == self.best:
                rivals.append(p)
            if not n:
                del self.n[p], self.at[p]
            elif n == self.best:
                if self.level and self.level[0][0] is None:
                    self.level = []  # a lone pick had no rank; it is merged by now
                heapq.heappush(self.level, (self.rank_of(p), p))
            else:
                heapq.heappush(self.heap, (-n, p))
        return any(self.touches_margin(p) for p in rivals)


# ---------------------------------------------------------------------------
# the loop
# ---------------------------------------------------------------------------
class MergeLog:
    """Merges in rank order, one table a round, in a folder that outlives the job."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> list[tuple[int, int, int]]:
        """(a, b, n) by rank; a round whose write did not end is not there."""
        out, k = [], 0
        while self._exists(f"{self.path}/round={k:06d}/_SUCCESS"):
            rows = self.spark.read.parquet(f"{self.path}/round={k:06d}").collect()
            out += [(r["a"], r["b"], r["n"]) for r in sorted(rows, key=lambda r: r["rank"])]
            k += 1
        self.rounds = k
        return out

    def append(self, first: int, merges: list[tuple[int, int, int]]) -> None:
        rows = [(first + i, *m) for i, m in enumerate(merges)]
        self.spark.createDataFrame(rows, "rank long, a long, b long, n long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/round={self.rounds:06d}")
        self.rounds += 1


def _ordered(sequences: DataFrame) -> DataFrame:
    """(ord, w, ids): places in corpus order as ascending numbers, texts as their bytes."""
    if "first" in sequences.columns:
        sequences = range_blocks(sequences, ["first"])
    return cut_lineage(sequences.select(
        F.monotonically_increasing_id().alias("ord"), F.lit(0).cast("long").alias("pos"), F.col("w").cast("long").alias("w"),
        F.col("text").cast("binary").alias("ids")))


def learn_merges(sequences: DataFrame, first_id: int, room: int, min_freq: int = 2,
                 tie_break: str = "first_seen", hot: int = HOT, log: str | None = None,
                 max_rounds: int | None = None) -> tuple[list[tuple[str, str, int]], str]:
    """Merges (hex a, hex b, n) in rank order, and why they end.

    ``sequences`` has (text, w, first).  New tokens are numbered from ``first_id``, at most
    ``room`` of them.  Pairs of one count go by their first occurrence in corpus order, or
    by their surfaces (``tie_break='smallest'``).  ``max_rounds`` stops early (reason
    ``stopped``); with ``log`` a later call goes on.
    """
    spark = sequences.sparkSession
    width = first_id + room
    surface = {i: f"{i:02X}" for i in range(256)}
    known = set(surface.values())
    merges: list[tuple[int, int, int]] = []
    smallest = tie_break == "smallest"

    def rank(pair, place):
        return (surface[pair[0]], surface[pair[1]]) if smallest else place

    def learn(a, b, n):
        new = first_id + len(merges)
        merges.append((a, b, n))
        surface[new] = surface[a] + surface[b]
        known.add(surface[new])
        return new

    saved = MergeLog(spark, log) if log else None
    full = Pending(_ordered(sequences), [], width, "<u1")
    for m in saved.read()[:room] if saved else []:
        learn(*m)
    full.triples = [(a, b, first_id + i) for i, (a, b, _) in enumerate(merges)]

    def again(top: int):
        """All sequences written with what is learned, the pairs counted from a part of ``top``
        on, and the sequences that these pairs make."""
        least = max(min_freq, top // SPAN)
        state, counts = full.counted(least)
        counts = cut_lineage(counts)
        uncut(full.base)
        return state, *cut(state, counts), least

    def cut(state, counts):
        known = _known(counts, width)
        return state if known is None else state.cut(known), counts, known

    if merges:
        full, state, counts, counted, least = again(merges[-1][2])
    else:
        counts = cut_lineage(full.counts_from(min_freq))  # pairs of bytes are few
        least = max(min_freq, (counts.agg(F.max("n")).first()[0] or 0) // SPAN)
        state, counts, counted = cut(full, cut_lineage(counts.where(F.col("n") >= least)))

    stop, rounds = "vocab_full", 0
    while len(merges) < room:
        if max_rounds is not None and rounds >= max_rounds:
            stop = "stopped"
            break
        top = counts.orderBy(F.desc("n")).limit(hot + 1).collect()
        best = int(top[0]["n"]) if top else 0
        if not top and least > min_freq:
            # a pair that was not counted is no more frequent now than it was then
            uncut(counts)
            if state is not full:
                uncut(state.base)
            full, state, counts, counted, least = again(least - 1)
            continue
        if not top:
            def pairs(order, pos, w, ids, offsets):
                return [pa.array(order[np.diff(offsets) > 1])]
            stop = "no_pairs" if full.read(pairs, "ord long").isEmpty() else "min_freq"
            break
        floor = int(top[hot]["n"]) if len(top) > hot else least - 1
        limit, around = None, None
        if floor < best:
            chosen = [(r["a"], r["b"]) for r in top if r["n"] > floor]
        else:  # more ties for the first place than fit
            chosen, limit, around = _first_tied(state, counts, best, hot, surface if smallest else None)
        runs, rows, tokens = _sized(state.runs(chosen, around, limit is not None and around is None))
        while len(chosen) > 1 and (rows > RUNS or tokens > 4 * RUN_TOKENS):
            hot = max(1, len(chosen) * 3 // 4 if limit is None else hot // 2)
            floor = int(top[hot]["n"]) if limit is None and len(top) > hot else floor
            chosen = [(r["a"], r["b"]) for r in top[:hot] if limit is None and r["n"] > floor]
            more = runs
            if chosen:
                runs, rows, tokens = _sized(fewer_runs(more, chosen, width))
            more.unpersist()
        if not chosen:  # those left tie
            continue
        fetched = [(bytes(r["run"]), int(r["w"]), int(r["at"])) for r in runs.collect()]
        runs.unpersist()
        work = RunMerger(fetched, set(chosen), rank)
        first, ended = len(merges), False
        while len(merges) < room:
            pick = work.pick()
            if pick is None:
                break
            n, pair = pick
            if limit is None and n <= floor:
                break
            if limit is not None and (n < best or limit[1] is not None and work.rank_of(pair) >= limit[1]):
                break
            if surface[pair[0]] + surface[pair[1]] in known:
                ended = True
                break
            if work.merge(pair, learn(*pair, n)):
                break
        picks = [(*merges[i][:2], first_id + i) for i in range(first, len(merges))]
        if picks:
            log_.info("round %d: merges %d to %d, count %d", rounds, first, len(merges) - 1, merges[-1][2])
            if saved:
                saved.append(first, merges[first:])
        if ended:
            stop = "exists"
            break
        rounds += 1
        if len(merges) < room:
            before, old = state, counts
            state, delta = before.advanced(picks, least, counted)
            if before is full:
                full = state
            else:
                full.triples = full.triples + picks
            changed = old.unionByName(delta).groupBy("a", "b").agg(F.sum("n").alias("n"))
            counts = cut_lineage(changed.where(F.col("n") >= least))
            counted = _known(counts, width)
            uncut(before.base)
            uncut(old)
        if rows < RUNS // 16 and tokens < RUN_TOKENS // 4:
            hot = min(MAX_HOT, hot * 2)
        if rows < RUNS // 4 and tokens < RUN_TOKENS:
            hot = min(MAX_HOT, hot * 2)
    return [(surface[a], surface[b], n) for a, b, n in merges], stop


def _known(counts: DataFrame, width: int) -> np.ndarray | None:
    """The sorted keys of the pairs that are counted, if they are few enough."""
    if counts.limit(KNOWN + 1).count() > KNOWN:
        return None

    def packed(batches):
        for batch in batches:
            keys = np.asarray(batch.column("a")) * width + np.asarray(batch.column("b"))
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary())], names=["keys"])

    rows = counts.mapInArrow(packed, "keys binary").collect()
    return np.sort(np.frombuffer(b"".join(r["keys"] for r in rows), np.int64))


def _sized(runs: DataFrame):
    """(runs, kept for a second reading; rows; bytes)"""
    runs = runs.persist(StorageLevel.MEMORY_AND_DISK)
    rows, size = runs.agg(F.count(F.lit(1)), F.sum(F.octet_length("run"))).first()
    log_.info("%d distinct runs, %d bytes", rows, size or 0)
    return runs, rows, size


def _first_tied(state: Pending, counts: DataFrame, best: int, hot: int, surface: dict | None):
    """The first ``hot`` pairs of the count ``best``; (best, rank of the next one); and the
    keys of all that tie, if they are few enough to broadcast."""
    tied = counts.where(F.col("n") == best)
    if surface is None:
        rows = state.counts(places=True).where(F.col("n") == best).orderBy("at").limit(hot + 1).collect()
        ranks = [int(r["at"]) for r in rows]
    else:
        spark = counts.sparkSession
        names = F.broadcast(spark.createDataFrame(list(surface.items()), "id long, s string"))
        rows = tied.join(names.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a") \
            .join(names.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b") \
            .orderBy("sa", "sb").limit(hot + 1).collect()
        ranks = [(r["sa"], r["sb"]) for r in rows]
    around = None
    if tied.count() <= TIED:
        keys = tied.select((F.col("a") * state.width + F.col("b")).alias("k")).toPandas()["k"]
        around = np.sort(keys.to_numpy(np.int64))
    return [(r["a"], r["b"]) for r in rows[:hot]], (best, ranks[hot] if len(ranks) > hot else None), around
