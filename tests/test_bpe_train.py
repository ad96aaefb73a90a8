"""Training many merges a round equals one merge after another: until a stop rule fires,
with ties beyond the hot set, repeated lines, long runs, and after a stop and resume."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from loomtext.operators import bpe, bpe_train, kernels


def corpus_of(seed, n, alphabet, length, repeats=0):
    pick = random.Random(seed)
    lines = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(length))) for _ in range(n)]
    lines += [pick.choice(lines) for _ in range(repeats)]
    return lines


def line_table(spark, lines):
    return spark.createDataFrame([(i // 5, i % 5, t) for i, t in enumerate(lines)],
                                 "doc_id long, line_no int, line string").repartition(3)


CORPORA = {
    "ties": corpus_of(1, 60, "abcdefghijklmnop", 12),
    "repeats": corpus_of(2, 25, "ab cé", 40, repeats=30),
    "runs": ["a" * n for n in range(1, 40)] + ["ab" * 30, "ba" * 31, "aab" * 9, "", "é" * 17] * 2,
}


@pytest.mark.parametrize("name,hot,min_freq", [
    ("ties", 1, 2), ("ties", 4, 2), ("ties", 4096, 1), ("repeats", 2, 2), ("repeats", 16, 2), ("runs", 3, 2)])
def test_lines_equal_brute_until_a_stop_rule(spark, monkeypatch, name, hot, min_freq):
    monkeypatch.setattr(bpe_train, "MAX_HOT", max(hot, 8))
    lines = CORPORA[name]
    m = bpe.train_line_bpe(line_table(spark, lines), vocab_size=400, min_freq=min_freq, hot=hot)
    merges, stop = brute.train(lines, 400 - 260, min_freq=min_freq)
    assert (m.merges, m.stop_reason) == (merges, stop)


@pytest.mark.parametrize("tie_break", ["first_seen", "smallest"])
def test_ties_too_many_to_broadcast(spark, monkeypatch, tie_break):
    monkeypatch.setattr(bpe_train, "TIED", 3)
    monkeypatch.setattr(bpe_train, "MAX_HOT", 4)
    lines = [" ".join(corpus_of(s, 3, "abc", 6)) for s in range(12)]
    if tie_break == "smallest":
        m = bpe.train_word_bpe(line_table(spark, lines), vocab_size=330)
        assert (m.merges, m.stop_reason) == words_brute(lines, 70)
    else:
        m = bpe.train_line_bpe(line_table(spark, lines), vocab_size=330)
        assert (m.merges, m.stop_reason) == brute.train(lines, 70)


def test_few_fetched_runs_shrink_the_hot_set(spark, monkeypatch):
    monkeypatch.setattr(bpe_train, "RUNS", 6)
    lines = CORPORA["repeats"]
    m = bpe.train_line_bpe(line_table(spark, lines), vocab_size=290, hot=64)
    assert m.merges == brute.train(lines, 30)[0]


def test_a_smaller_hot_set_reads_no_sequences_again(spark, monkeypatch):
    reads, rounds = [], []
    runs, merger = bpe_train.Pending.runs, bpe_train.RunMerger
    monkeypatch.setattr(bpe_train, "RUNS", 6)
    monkeypatch.setattr(bpe_train.Pending, "runs", lambda *a: reads.append(0) or runs(*a))
    monkeypatch.setattr(bpe_train, "RunMerger", lambda *a: rounds.append(0) or merger(*a))
    lines = corpus_of(4, 40, "aabcd", 30, repeats=5)
    m = bpe.train_line_bpe(line_table(spark, lines), vocab_size=264, hot=16)
    assert m.merges == brute.train(lines, 4)[0]
    assert len(reads) == len(rounds)


@pytest.mark.parametrize("name", ["repeats", "runs"])
def test_runs_of_fewer_pairs_are_cut_out_of_those_of_more(spark, name):
    seqs = bpe.line_sequences(line_table(spark, CORPORA[name] + [""]), ["doc_id", "line_no"])
    state = bpe_train.Pending(bpe_train._ordered(seqs), [], 300, "<u1")
    top = [(r["a"], r["b"]) for r in state.counts().orderBy("n", "a", "b").collect()[-6:]]
    few = bpe_train.fewer_runs(state.runs(top), top[-2:], 300)
    assert sorted(few.collect()) == sorted(state.runs(top[-2:]).collect())
    assert few.count() > 1


def words_brute(lines, n, min_freq=2):
    """Word rule with ties to the smallest surfaces, one merge at a time."""
    import regex

    from loomtext.functions.text import WORD_PATTERN
    find = regex.compile(WORD_PATTERN.replace("(?U)", "")).findall
    seqs = [[f"{b:02X}" for b in w.encode()] for t in lines for w in find(t)]
    merges, known = [], {f"{b:02X}" for b in range(256)}
    while len(merges) < n:
        counts = {}
        for s in seqs:
            for p in zip(s, s[1:]):
                counts[p] = counts.get(p, 0) + 1
        if not counts:
            return merges, "no_pairs"
        best = min(counts, key=lambda p: (-counts[p], p))
        if counts[best] < min_freq:
            return merges, "min_freq"
        if best[0] + best[1] in known:
            return merges, "exists"
        known.add(best[0] + best[1])
        merges.append((*best, counts[best]))
        seqs = [brute.join_pair(s, *best) for s in seqs]
    return merges, "vocab_full"


@pytest.mark.parametrize("hot,min_freq", [(1, 2), (5, 2), (4096, 1)])
def test_words_equal_brute_until_a_stop_rule(spark, monkeypatch, hot, min_freq):
    monkeypatch.setattr(bpe_train, "MAX_HOT", max(hot, 8))
    lines = [" ".join(corpus_of(s, 4, "abcd", 7)) for s in range(30)]
    m = bpe.train_word_bpe(line_table(spark, lines), vocab_size=380, min_freq=min_freq, hot=hot)
    assert (m.merges, m.stop_reason) == words_brute(lines, 380 - 260, min_freq)


def test_killed_and_resumed_training_equals_one_run(spark, tmp_path):
    table = line_table(spark, CORPORA["repeats"])
    log = str(tmp_path / "merges")
    whole = bpe.train_line_bpe(table, vocab_size=400, hot=4)
    part = bpe.train_line_bpe(table, vocab_size=400, hot=4, log=log, max_rounds=2)
    assert part.stop_reason == "stopped" and 0 < len(part.merges) < len(whole.merges)
    # a round whose write was cut short does not count
    os.makedirs(os.path.join(log, "round=000002"))
    again = bpe.train_line_bpe(table, vocab_size=400, hot=4, log=log)
    assert (again.merges, again.stop_reason) == (whole.merges, whole.stop_reason)
    replayed = bpe.train_line_bpe(table, vocab_size=400, hot=4, log=log)
    assert replayed.merges == whole.merges


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, line_no int, line string")
    assert bpe.train_line_bpe(empty).stop_reason == "no_pairs"
    once = line_table(spark, ["abc", "", "xyz"])
    assert bpe.train_line_bpe(once).stop_reason == "min_freq"
    assert bpe.train_line_bpe(once, vocab_size=100).merges == []


def _by_rank(tokens, triples):
    for a, b, c in triples:
        out, i = [], 0
        while i < len(tokens):
            if tokens[i:i + 2] == [a, b]:
                out.append(c)
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), max_size=8), st.integers(0, 2 ** 32), st.integers(2, 40))
def test_rank_kernel_equals_merging_in_rank_order(seqs, seed, long):
    pick = random.Random(seed)
    triples = []
    while len(triples) < 10:
        a, b = (pick.randrange(3 + len(triples)) for _ in range(2))
        if (a, b) not in [t[:2] for t in triples]:
            triples.append((a, b, 3 + len(triples)))
    flat = np.array([x for s in seqs for x in s], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
    old, kernels.LONG = kernels.LONG, long
    try:
        ids, ends = kernels.merge_by_rank(flat, offsets, kernels.pair_table(triples, 13), 13)
    finally:
        kernels.LONG = old
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [_by_rank(s, triples) for s in seqs]


def test_a_long_word_does_not_make_short_ones_be_read_again():
    """The work list: passes over the short words end when they are done."""
    pick = np.random.RandomState(3)
    long, short = pick.randint(0, 3, 2000), pick.randint(0, 3, 60_000)
    triples = [(0, 1, 3), (3, 2, 4), (4, 4, 5), (1, 1, 6), (6, 0, 7)]
    table = kernels.pair_table(triples, 8)
    seen = []
    real = kernels.lookup

    def counting(keys, probe):
        seen.append(len(probe))
        return real(keys, probe)

    kernels.lookup = counting
    try:
        ids = np.concatenate([long, short]).astype(np.int64)
        offsets = np.concatenate([[0], np.arange(2000, 62_001, 3)]).astype(np.int64)
        kernels.merge_set_fixpoint(ids, offsets, table, 8)
    finally:
        kernels.lookup = real
    assert seen[0] == 61_999 and seen[-1] < 3000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=8), st.integers(0, 2 ** 32))
def test_merging_run_by_run_equals_merging_in_rank_order(seqs, seed):
    pick = random.Random(seed)
    triples = []
    while len(triples) < 6:
        a, b = (pick.randrange(4 + len(triples)) for _ in range(2))
        if (a, b) not in [t[:2] for t in triples]:
            triples.append((a, b, 4 + len(triples)))
    flat = np.array([x for s in seqs for x in s], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
    ids, ends, changed, fresh = kernels.merge_runs(
        flat, offsets, kernels.pair_table(triples, 10), kernels.join_keys(triples, 10), 10)
    merged = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert merged == [_by_rank(s, triples) for s in seqs]
    assert (flat[~changed] == ids[~fresh]).all() and len(changed) == len(flat) and len(fresh) == len(ids)


def test_merges_apart_from_each_other_take_one_pass():
    """Sixty merges in one line: a pass for each of them before."""
    triples = [(2 * i, 2 * i + 1, 200 + i) for i in range(60)]
    line = np.array([t for a, b, _ in triples for t in (a, b, 199)], np.int64)
    seen = []
    real = kernels.lookup

    def counting(keys, probe):
        seen.append(len(probe))
        return real(keys, probe)

    kernels.lookup = counting
    try:
        ids, ends, _, _ = kernels.merge_runs(line, np.array([0, len(line)]), kernels.pair_table(triples, 300),
                                             kernels.join_keys(triples, 300), 300)
    finally:
        kernels.lookup = real
    assert ids.tolist() == [t for _, _, c in triples for t in (c, 199)] and ends.tolist() == [0, 120]
    assert len(seen) <= 3


def test_sequences_are_stored_packed_and_the_delta_tells_the_new_counts(spark):
    lines = CORPORA["repeats"] + CORPORA["runs"]
    state = bpe_train.Pending(bpe_train._ordered(bpe.line_sequences(line_table(spark, lines), ["doc_id", "line_no"])),
                              [], 300, "<u1")
    assert dict(state.table.dtypes)["ids"] == "binary"  # an array of numbers before
    triples = [(97, 98, 260), (97, 97, 261), (260, 260, 262), (32, 97, 263), (261, 261, 264)]

    def table(counts):
        out = {}
        for r in counts.collect():
            out[r["a"], r["b"]] = out.get((r["a"], r["b"]), 0) + r["n"]
        return {p: n for p, n in out.items() if n}

    moved = table(state.counts().unionByName(state.delta(triples)))
    state.triples = triples
    assert moved == table(state.counts()) == table(state.rewritten().counts())


def test_many_probes_are_found_as_few_are():
    keys = np.unique(np.random.RandomState(1).randint(0, 5000, 700)) * 1_000_003
    probe = np.random.RandomState(2).randint(0, 5000, 3 * kernels.MANY) * 1_000_003
    found, at = kernels.lookup(keys, probe)
    assert (found == np.isin(probe, keys)).all() and (keys[at[found]] == probe[found]).all()


def test_pairs_of_few_tokens_are_found_as_by_search():
    pick = np.random.default_rng(3)
    ids = pick.integers(0, 276, kernels.MANY + 7)
    offsets = np.sort(np.concatenate([[0, len(ids)], pick.integers(0, len(ids), 40)]))
    keys = np.unique(pick.integers(0, 276 * 276, 90))
    seg = kernels.segment_ids(offsets)
    found, at = kernels.adjacent(ids, seg, keys, 276)
    pair = ids[:-1] * 276 + ids[1:]
    want = np.isin(pair, keys) & (seg[:-1] == seg[1:])
    assert (found == want).all() and want.any() and (keys[at[found]] == pair[found]).all()
    for none in (kernels.adjacent(ids, seg, keys[:0], 276)[0], kernels.adjacent(ids[:0], seg[:0], keys, 276)[0]):
        assert not none.any()


def test_the_run_merger_keeps_numbers_packed_and_places_beyond_64_bits():
    far = (1 << 70) + 5
    runs = [(bytes(2) + np.array(t, np.int32).tobytes(), w, at) for t, w, at in (
        ([3, 4, 3, 4], 2, far), ([1, 2, 1, 2], 1, 7), ([1, 2], 2, 1 << 65))]
    work = bpe_train.RunMerger(runs, {(1, 2), (3, 4)}, lambda pair, place: place)
    assert work.pick() == (4, (1, 2))  # the first of those that tie
    assert (work.rank_of((1, 2)), work.rank_of((3, 4))) == (7, far)
    assert all(x.itemsize == 8 for x in (work.token, work.after, work.before, work.weight))
