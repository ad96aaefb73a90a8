"""Training and line encoding at size: few passes over all sequences, little work in each."""

import random

import numpy as np

import brute
from loomtext.operators import bpe, bpe_train, kernels


def lines_of_words(n, seed=7):
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdefgh") for _ in range(pick.randrange(2, 7))) for _ in range(30)]
    return [" ".join(pick.choices(words, k=9)) for _ in range(n)]


def table(spark, lines):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)],
                                 "doc_id long, line_no int, line string").repartition(3)


def test_rounds_read_the_distinct_runs_not_all_sequences(spark, monkeypatch):
    rows, runs, rounds, merger = [], bpe_train.Pending._runs, [], bpe_train.RunMerger
    monkeypatch.setattr(bpe_train.Pending, "_runs", lambda self, *a: rows.append(self.table.count()) or runs(self, *a))
    monkeypatch.setattr(bpe_train, "RunMerger", lambda *a: rounds.append(0) or merger(*a))
    monkeypatch.setattr(bpe_train, "MAX_HOT", 1)
    pick = random.Random(3)
    noise = ["".join(pick.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=6)) for _ in range(900)]
    between = ["he", "the", "the ", " the "]
    lines = [noise[i] + between[i % 4] + noise[i + 1] + between[i % 3 + 1] + noise[i + 2] for i in range(0, 900, 3)]
    m = bpe.train_line_bpe(table(spark, lines), vocab_size=263, hot=1)
    assert m.merges == brute.train(lines, 3)[0]
    whole = sum(n == 300 for n in rows)  # one a round before
    assert len(rounds) >= 3 and whole == 1 and max(rows[1:]) < 250, (rows, len(rounds))


def test_pairs_that_were_not_counted_are_counted_again(spark):
    lines = lines_of_words(40) + ["zq" * 3, "zq"]
    m = bpe.train_line_bpe(table(spark, lines), vocab_size=420)
    assert (m.merges, m.stop_reason) == brute.train(lines, 160)


def test_one_pass_gives_the_merged_sequences_and_the_counts(spark):
    lines = lines_of_words(50) + ["aaaa bb"] * 9
    state = bpe_train.Pending(bpe_train._ordered(bpe.line_sequences(table(spark, lines), ["doc_id", "line_no"])),
                              [], 300, "<u1")
    triples = [(97, 98, 260), (97, 97, 261), (260, 260, 262), (32, 97, 263)]
    state.triples = triples
    want = {(r["a"], r["b"]): r["n"] for r in state.counts().collect()}
    written, counts = state.counted(3)
    assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == {p: n for p, n in want.items() if n >= 3}
    assert {(r["a"], r["b"]): r["n"] for r in written.counts().collect()} == want and not written.triples


def test_a_later_scan_of_a_line_looks_only_at_new_tokens(monkeypatch):
    """Merges that go on at one place of a long line: the whole line was scanned for each before."""
    triples = [(1, 2, 10), (10, 3, 11), (11, 4, 12), (12, 5, 13), (13, 6, 14)]
    line = np.array([9] * 5000 + [1, 2, 3, 4, 5, 6] + [9] * 5000)
    seen, real = [], kernels.lookup
    monkeypatch.setattr(kernels, "lookup", lambda keys, probe: seen.append(len(probe)) or real(keys, probe))
    ids, ends = kernels.merge_set_fixpoint(line, np.array([0, len(line)]), kernels.pair_table(triples, 20), 20)
    assert ids.tolist() == [9] * 5000 + [14] + [9] * 5000 and ends.tolist() == [0, 10_001]
    assert seen[0] == len(line) - 1 and sum(seen[1:]) <= 20


def test_masks_and_groups_equal_search(monkeypatch):
    pick = np.random.default_rng(2)
    for cells in (kernels.CELLS, 1):
        monkeypatch.setattr(kernels, "CELLS", cells)
        for _ in range(60):
            ids = pick.integers(0, 40, pick.integers(0, 400)).astype(pick.choice(["u1", "u2", "i4"]))
            offsets = np.sort(np.concatenate([[0, len(ids)], pick.integers(0, len(ids) + 1, 5)]))
            keys = np.unique(pick.integers(0, 1600, pick.integers(0, 300)))
            wide = ids.astype(np.int64)
            want = kernels.adjacent(wide, kernels.segment_ids(offsets), keys, 40)[0]
            mask = kernels.pair_mask(ids, offsets, keys, 40)
            assert (mask == want).all()
            start, stop = kernels.runs_of(mask)
            tokens = kernels.run_tokens(ids, mask) if len(ids) else ids
            first, group = kernels.equal_groups(tokens, stop - start)
            runs = [ids[a:b].tolist() for a, b in zip(start, stop)]
            assert [runs[first[g]] for g in group] == runs and len(first) == len({tuple(r) for r in runs})


def test_keys_that_share_a_place_are_found():
    pick = np.random.default_rng(4)
    keys = np.unique(pick.integers(0, 10 ** 9, 30_000))
    probe = np.concatenate([keys, pick.integers(0, 10 ** 9, 30_000)])
    found, at = kernels.lookup(keys, probe)
    assert (found == np.isin(probe, keys)).all() and (keys[at[found]] == probe[found]).all()
    assert len(kernels._SLOTS[3]) > 0  # some do
