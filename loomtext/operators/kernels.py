"""Numpy kernels over token sequences: many sequences end to end, with offsets.

``ids[offsets[i]:offsets[i + 1]]`` is sequence i.  The merge rules keep a work list: a
sequence that a pass leaves as it is gets set aside, so a later pass costs what the
unfinished sequences hold, and one very long word does not make the rest be read
again.  Rank-ordered merging of a long sequence runs over a heap of its pairs, since
its passes would each change only a few of its tokens.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa

#: Tokens from which a sequence is merged by the heap.
LONG = 2048


def utf8_ids(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Arrow string array → (byte values uint8, offsets int64[len+1]); NULL = ''."""
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def segment_ids(offsets: np.ndarray) -> np.ndarray:
    lengths = np.diff(offsets)
    return np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)


def pair_table(triples, width: int):
    """(sorted pair keys, merged ids, ranks) of (a, b, ab) triples in rank order."""
    keys = np.array([a * width + b for a, b, _ in triples], dtype=np.int64)
    vals = np.array([c for _, _, c in triples], dtype=np.int64)
    ranks = np.arange(len(triples), dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], vals[order], ranks[order]


#: Probes from which a table of hashed keys sorts out most misses before the search, or
#: small keys have a table by value.
MANY, HASHED, DIRECT = 1 << 14, 1 << 18, 1 << 18


def _hashed(keys):
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


#: Probes and keys from which a table of places, made once for these keys, answers.
SOME = 1 << 11
_SLOTS: list = [None]


def _by_slot(keys, probe):
    """(found, index): the place of a key lies at its hash; of keys that share one the last
    lies there, and the others are searched."""
    if _SLOTS[0] is not keys:
        shift = np.uint64(62 - len(keys).bit_length() - 2)
        places = np.zeros(1 << (64 - int(shift)), np.int32)
        at = _slot(keys, shift)
        places[at] = np.arange(len(keys))
        lost = np.flatnonzero(places[at] != np.arange(len(keys)))
        shared = np.zeros(len(places), bool)
        shared[at[lost]] = True
        _SLOTS[:] = [keys, shift, places, lost, shared]
    _, shift, places, lost, shared = _SLOTS
    at = _slot(probe, shift)
    idx = places[at].astype(np.int64)
    found = keys[idx] == probe
    if len(lost):
        left = np.flatnonzero(shared[at] & ~found)
        near = lost[np.minimum(np.searchsorted(keys[lost], probe[left]), len(lost) - 1)]
        found[left], idx[left] = keys[near] == probe[left], near
    return found, idx


def _slot(keys, shift):
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def lookup(keys_sorted, probe):
    """(found, index) of each probe in the sorted keys."""
    if len(keys_sorted) == 0:
        return np.zeros(len(probe), bool), np.zeros(len(probe), np.int64)
    top = int(keys_sorted[-1]) + 1
    if len(probe) >= MANY and keys_sorted[0] >= 0 and top <= DIRECT:
        there, place = np.zeros(top + 1, bool), np.zeros(top + 1, np.int64)
        there[keys_sorted], place[keys_sorted] = True, np.arange(len(keys_sorted))
        near = np.minimum(probe.astype(np.uint64), np.uint64(top)).view(np.int64)  # negative ones are beyond it
        return there[near], place[near]
    if len(probe) >= SOME and len(keys_sorted) >= SOME:
        return _by_slot(keys_sorted, probe)
    if len(probe) >= MANY and len(keys_sorted) < HASHED // 8:
        there = np.zeros(HASHED, bool)
        there[_hashed(keys_sorted)] = True
        at = np.flatnonzero(there[_hashed(probe)])
        found, idx = np.zeros(len(probe), bool), np.zeros(len(probe), np.int64)
        near = np.minimum(np.searchsorted(keys_sorted, probe[at]), len(keys_sorted) - 1)
        found[at], idx[at] = keys_sorted[near] == probe[at], near
        return found, idx
    idx = np.minimum(np.searchsorted(keys_sorted, probe), len(keys_sorted) - 1)
    return keys_sorted[idx] == probe, idx


#: Tokens that one step of a scan works on, and cells of a table of pairs: both stay in the cache.
STEP, CELLS = 1 << 16, 1 << 24


def inner(offsets, n: int) -> np.ndarray:
    """Which of the ``n - 1`` neighbours are of one sequence."""
    mask = np.ones(max(0, n - 1), bool)
    ends = offsets[(offsets > 0) & (offsets < n)]
    mask[ends - 1] = False
    return mask


def pair_mask(ids, offsets, keys, width: int) -> np.ndarray:
    """Which neighbours of one sequence are in the sorted pair keys: ``adjacent`` without
    places, by a table of the keys' first and second tokens."""
    n = len(ids)
    if not len(keys) or n < 2:
        return np.zeros(max(0, n - 1), bool)
    left, right = np.unique(keys // width), np.unique(keys % width)
    across = len(right) + 1
    if (len(left) + 1) * across > CELLS:
        first, second = np.zeros(width, bool), np.zeros(width, bool)
        first[left] = second[right] = True
        mask = first[ids[:-1]] & second[ids[1:]] & inner(offsets, n)
        mask[mask] = lookup(keys, ids[:-1][mask].astype(np.int64) * width + ids[1:][mask])[0]
        return mask
    rows, cols = np.zeros(width, np.int32), np.zeros(width, np.int32)
    rows[left] = np.arange(1, len(left) + 1) * across
    cols[right] = np.arange(1, across)
    table = np.zeros((len(left) + 1) * across, bool)
    table[rows[keys // width] + cols[keys % width]] = True
    mask = np.empty(n - 1, bool)
    for at in range(0, n - 1, STEP):
        near = ids[at:at + STEP + 1]
        mask[at:at + STEP] = table[rows[near[:-1]] + cols[near[1:]]]
    mask &= inner(offsets, n)
    return mask


def runs_of(mask) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the tokens that each run of neighbours holds."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2] + 1


def run_tokens(ids, mask):
    """The tokens that lie in runs of neighbours, end to end."""
    inside = np.zeros(len(ids), bool)
    inside[:-1] = mask
    inside[1:] |= mask
    return ids[inside]


def equal_groups(tokens, lengths) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that lie end to end: the first of each group of equal ones, in order, and
    each run's group.  Compared by their bytes, not by a hash alone."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * tokens.itemsize
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [
        None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(tokens))])
    group = np.asarray(runs.dictionary_encode().indices, np.int64)
    first = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    return first, group


def adjacent(ids, seg, keys, width: int):
    """(found, index): which neighbours of one sequence are in the sorted pair keys."""
    found, idx = lookup(keys, ids[:-1] * width + ids[1:])
    return found & (seg[:-1] == seg[1:]), idx


def every_second(mask: np.ndarray) -> np.ndarray:
    """Positions of each run of True, every second one from the run's first."""
    starts = mask & ~np.concatenate([[False], mask[:-1]])
    first = np.maximum.accumulate(np.where(starts, np.arange(len(mask)), 0))
    pos = np.flatnonzero(mask)
    return pos[((pos - first[pos]) % 2) == 0]


def gather(flat, offsets, take) -> tuple[np.ndarray, np.ndarray]:
    """The sequences ``take`` (any order, repeats allowed), end to end."""
    lengths = np.diff(offsets)[take]
    out = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    inside = np.arange(out[-1], dtype=np.int64) - np.repeat(out[:-1], lengths)
    return flat[np.repeat(offsets[:-1][take], lengths) + inside], out


def _replace(ids, offsets, seg, at, new_ids):
    """ids[p] becomes the new id and ids[p + 1] goes, for each p in ``at``."""
    ids = ids.copy()
    ids[at] = new_ids
    keep = np.ones(len(ids), bool)
    keep[at + 1] = False
    removed = np.bincount(seg[at], minlength=len(offsets) - 1)
    return ids[keep], offsets - np.concatenate([[0], np.cumsum(removed)])


def _passes(ids, offsets, choose):
    """Replace what ``choose(ids, seg, n)`` picks until it picks nothing; a sequence
    without a pick is finished."""
    number = np.arange(len(offsets) - 1)
    done = []
    while len(number):
        seg = segment_ids(offsets)
        at, new_ids = choose(ids, seg, len(number))
        live = np.zeros(len(number), bool)
        live[seg[at]] = True
        if not live.all():
            rest = np.flatnonzero(~live)
            done.append((number[rest], *gather(ids, offsets, rest)))
            token_live = live[seg]
            at = (np.cumsum(token_live) - 1)[at]
            ids, offsets = gather(ids, offsets, np.flatnonzero(live))
            seg, number = segment_ids(offsets), number[live]
        if len(number):
            ids, offsets = _replace(ids, offsets, seg, at, new_ids)
    if not done:
        return ids, offsets
    order = np.argsort(np.concatenate([n for n, _, _ in done]), kind="stable")
    flat = np.concatenate([f for _, f, _ in done])
    lengths = np.concatenate([np.diff(o) for _, _, o in done])
    return gather(flat, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), order)


def merge_set_fixpoint(ids, offsets, table, width):
    """Line rule: any adjacent pair in the merge set, left to right, until nothing changes.
    In a run of mergeable positions from s, a scan merges s, s + 2, ..."""
    keys, vals, _ = table
    if len(ids) < 2 or not len(keys):
        return ids, offsets
    top = int(ids.max()) + 1
    known = np.flatnonzero((keys // width < top) & (keys % width < top))  # all that the first scan can meet
    ids = ids.astype(np.int32 if top < 1 << 15 else np.int64)
    found, idx = adjacent(ids, segment_ids(offsets), keys[known] // width * top + keys[known] % width, top)
    at = every_second(found)
    new_ids = vals[known[idx[at]]] if len(at) else at
    while len(at):
        ids[at] = new_ids
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids, offsets = ids[keep], offsets - np.searchsorted(at + 1, offsets)
        # two neighbours that the scan left as they were do not merge: only new tokens' are looked up
        fresh = at - np.arange(len(at))
        near = np.stack([fresh - 1, fresh], axis=1).ravel()
        first = np.zeros(len(ids) + 1, bool)
        first[offsets] = True
        new = np.concatenate([[True], near[1:] != near[:-1]]) & (near >= 0) & ~first[near + 1]
        near = near[new]
        found, idx = lookup(keys, ids[near].astype(np.int64) * width + ids[near + 1])
        near, idx = near[found], idx[found]
        place = np.arange(len(near))
        alone = np.concatenate([[True], near[1:] != near[:-1] + 1])[:len(near)]
        pick = (place - np.maximum.accumulate(np.where(alone, place, 0))) % 2 == 0
        at, new_ids = near[pick], vals[idx[pick]]
    return ids, offsets


def merge_by_rank(ids, offsets, table, width):
    """Word rule: each sequence merges all occurrences of its lowest-rank pair, again and
    again; the same as applying all merges in rank order."""
    keys, vals, ranks = table
    big = np.iinfo(np.int64).max
    long = np.flatnonzero(np.diff(offsets) >= LONG)
    if len(long):
        short = np.flatnonzero(np.diff(offsets) < LONG)
        flat, ends = merge_by_rank(*gather(ids, offsets, short), table, width)
        parts, lengths = [flat], [np.diff(ends)]
        by_pair = {int(k): (int(r), int(v)) for k, v, r in zip(keys, vals, ranks)}
        for i in long:
            parts.append(_merge_long(ids[offsets[i]:offsets[i + 1]], by_pair, width))
            lengths.append([len(parts[-1])])
        order = np.argsort(np.concatenate([short, long]), kind="stable")
        return gather(np.concatenate(parts),
                      np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64), order)

    def choose(ids, seg, n):
        found, idx = adjacent(ids, seg, keys, width)
        rank = np.where(found, ranks[idx] if len(ranks) else 0, big)
        best = np.full(n, big, np.int64)
        np.minimum.at(best, seg[:-1], rank)
        at = every_second(found & (rank == best[seg[:-1]]))
        return at, vals[idx[at]]

    return _passes(ids, offsets, choose)


def join_keys(triples, width: int):
    """Sorted keys of the neighbours between which the merges can ever join, by the first
    and last token that each merged one starts from.  A merged id has one pair."""
    first, last, keys = {}, {}, set()
    for a, b, c in triples:
        keys.add(last.get(a, a) * width + first.get(b, b))
        first[c], last[c] = first.get(a, a), last.get(b, b)
    return np.array(sorted(keys), np.int64)


def merge_runs(ids, offsets, table, joins, width):
    """``merge_by_rank`` on sequences that hold no merged id yet: (ids, offsets, changed,
    fresh).  No merge crosses neighbours that are not in ``joins`` (``join_keys``), so each
    run between such places is merged by itself, equal ones once, in few passes.  ``changed``
    marks the old tokens of runs that shrank, ``fresh`` the new ones."""
    member = pair_mask(ids, offsets, joins, width)
    if not member.any():
        nothing = np.zeros(len(ids), bool)
        return ids, offsets, nothing, nothing
    start, stop = runs_of(member)
    lengths = stop - start
    tokens = run_tokens(ids, member)
    first, group = equal_groups(tokens, lengths)
    flat, ends = gather(tokens, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), first)
    flat, ends = merge_by_rank(flat.astype(np.int64), ends, table, width)
    size = np.diff(ends)
    shrank = np.flatnonzero((size < lengths[first])[group])
    start, lengths, group = start[shrank], lengths[shrank], group[shrank]
    left = size[group]
    flat, ends = gather(flat, ends, group)
    at = np.repeat(start - ends[:-1], left) + np.arange(len(flat))
    edge = np.zeros(len(ids) + 1, np.int8)
    edge[start] += 1
    edge[start + lengths] -= 1
    changed = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    out, keep = ids.astype(np.result_type(ids, np.min_scalar_type(width))), ~changed
    out[at], keep[at] = flat, True
    fresh = np.zeros(len(ids), bool)
    fresh[at] = True
    gone = np.concatenate([[0], np.cumsum(lengths - left)])
    return out[keep], offsets - gone[np.searchsorted(start, offsets)], changed, fresh[keep]


def _merge_long(ids, by_pair, width):
    """One sequence by rank: a heap of (rank, position) over a linked list."""
    token = ids.tolist()
    n = len(token)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def push(i):
        j = after[i]
        if j < n:
            known = by_pair.get(token[i] * width + token[j])
            if known:
                heapq.heappush(heap, (known[0], i, token[i], token[j], known[1]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if token[i] != a or j >= n or token[j] != b:
            continue
        token[i], token[j] = new, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return np.array([t for t in token if t >= 0], np.int64)
