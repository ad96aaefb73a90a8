"""Token files, packing and near-duplicates against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import LOWER, PROSE, texts_of  # noqa: I001
from loomtext.llm import hilbert_pack, pfor, setsketch, text_hash
from loomtext.llm.bpe_ids import default_vocabulary, encoder
from loomtext.llm.components import components


def library_ids(text, end):
    ids = encoder(default_vocabulary()).lib.encode(text or "", add_special_tokens=False).ids
    return np.asarray(ids + [end], "<u4")


def test_encoder_equals_library():
    enc, rnd = encoder(default_vocabulary()), random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", ",", ".", "..", "é", "'s", "n't", "17", " ", "x.", " \n",
             "<|endoftext|>", "中", "　", "\r\n", "!?", " ,", "\x1c"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert enc.encode(t) == library_ids(t, 0)[:-1].astype(enc.dtype).tobytes(), repr(t)


@pytest.mark.parametrize("n", [0, 1, 7, 1023, 1024, 1025, 5000])
def test_segment_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n).clip(0, 2 ** 32 - 1), rng.integers(0, 2, n), np.full(n, 2 ** 32 - 1), np.zeros(n)):
        ids = ids.astype(np.uint32)
        payload = pfor.write_segment(ids)
        assert (pfor.read_segment(payload) == ids).all()
        for b in range(-(-n // pfor.BLOCK)):
            assert (pfor.read_block(payload, b) == ids[b * pfor.BLOCK:(b + 1) * pfor.BLOCK]).all()
    with pytest.raises(ValueError):
        pfor.read_segment(b"none" + payload[4:])


def test_outliers_are_exceptions():
    ids = np.full(1024, 5, np.uint32)
    ids[100] = 2 ** 31
    assert len(pfor.write_segment(ids)) < 120


def test_token_files(edges, docs, no_docs):
    for df in (edges, docs):
        rows = sorted(pfor.round_trip(df).collect(), key=lambda r: r.start)
        at = 0
        for r in rows:
            assert r.start == at
            at += r.n_tokens
        assert [r.doc_id for r in rows] == [i for i, _ in texts_of(df)]
        want = Counter((i, len(x := library_ids(t, 0)), zlib.crc32(x.tobytes())) for i, t in texts_of(df))
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert pfor.round_trip(no_docs).count() == 0


def test_packing(edges, docs, no_docs):
    for df in (edges, docs):
        rows = hilbert_pack.pack(df).collect()
        ids = {(i, t): library_ids(t, 1) for i, t in texts_of(df)}
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
            pieces[(r.doc_id, r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
        for s in sequences.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at and length > 0
                at += length
            assert at <= 2048
        fill = sum(r.length for r in rows)
        assert len(sequences) == -(-fill // 2048) and sorted(sequences) == list(range(len(sequences)))
        assert fill == sum(len(library_ids(t, 1)) for _, t in texts_of(df))
        for (i, t), x in ids.items():
            for start, length, crc in pieces[(i, len(x))]:
                if (i, t) and sum(1 for k in ids if k[0] == i) == 1:
                    assert zlib.crc32(x[start:start + length].tobytes()) == crc
    assert hilbert_pack.pack(no_docs).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours(dims, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dims)))
    key = hilbert_pack.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_estimate_keeps_unlucky_pairs():
    """Sets of similarity 0.8 are dropped uncounted far less often than they share no band."""
    agree = np.arange(setsketch.REGISTERS + 1)
    a = np.zeros((len(agree), setsketch.REGISTERS), np.uint16)
    b = a.copy()
    for k in agree:
        more = (setsketch.REGISTERS - k) // 2
        a[k, :more], b[k, more:setsketch.REGISTERS - k] = 1, 1
    same = np.full(len(agree), 1000)
    dropped = agree[setsketch.estimate(a, b, same, same) < 0.8 - setsketch.SLACK]
    n = setsketch.REGISTERS
    assert sum(math.comb(n, int(k)) * 0.8 ** int(k) * 0.2 ** (n - int(k)) for k in dropped) < 5e-9


def words(t):
    return [w for w in (t or "").translate(LOWER).replace("\n", " ").replace("\t", " ").replace("\r", " ")
            .replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def shingles(t, width):
    w = words(t)
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


def brute_near(rows, width, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    out = Counter()
    for i, (k, _) in enumerate(rows):
        c = min((x for x in least[find(i)] if x is not None), default=None)
        out[(k, len(sets[i]), c, k == c)] += 1
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(edges, docs, no_docs, width):
    for df in (edges, docs):
        got = setsketch.near_duplicates(df, width=width).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(texts_of(df), width)
    assert setsketch.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("shingles", [1 << 21, 500])
def test_large_group_of_near_copies(spark, monkeypatch, shingles):
    """Copies of copies: many members do not link to the hub; blocks are small."""
    monkeypatch.setattr(setsketch, "LEFT", 8)
    monkeypatch.setattr(setsketch, "RIGHT", 16)
    monkeypatch.setattr(setsketch, "SHINGLES", shingles)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 14)):
            w[rnd.randrange(len(w))] = f"y{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = setsketch.near_duplicates(df, width=2).collect()
    want = brute_near(rows, 2)
    assert len({c for _, _, c, _ in want}) > 3
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_block_links_are_a_spanning_forest():
    """A block of a thousand like rows returns fewer links than rows; groups stay apart."""
    rng = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([rng.integers(0, 1 << 62, 6, dtype=np.uint64), base]))
            for base in (rng.integers(0, 1 << 62, 300, dtype=np.uint64) for _ in range(3)) for _ in range(100)]
    regs = setsketch.sketches(np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets]))
    rows = [(i, side, True, len(x), r.tobytes(), x.tobytes())
            for side in (0, 1) for i, (x, r) in enumerate(zip(sets, regs, strict=True))]
    got = setsketch._block(80)(pd.DataFrame(rows, columns=["cid", "side", "stray", "n", "regs", "set"]))
    assert len(got) == 3 * 99 and (got["a"] // 100 == got["b"] // 100).all()
    reached = {0, 100, 200}
    for _ in range(300):
        reached |= {b for a, b in zip(got["a"], got["b"], strict=True) if a in reached}
        reached |= {a for a, b in zip(got["a"], got["b"], strict=True) if b in reached}
    assert reached == set(range(300))


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.8, 0.95):
        n, both = 2000, int(2000 * 2 * j / (1 + j))
        pool = rng.integers(0, 2 ** 63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n:2 * n - both]])
        s = setsketch.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        got = setsketch.estimate(s[:1], s[1:], np.array([n]), np.array([n]))[0]
        assert abs(got - j) < 0.15
    both = setsketch.sketches(np.union1d(a, b), np.array([0, len(np.union1d(a, b))]))
    assert (both[0] == np.maximum(s[0], s[1])).all()  # mergeable


def test_word_hashes_split_long_texts(monkeypatch):
    monkeypatch.setattr(text_hash, "CHUNK", 16)
    import pyarrow as pa
    texts = ["one two three four five six seven", "", "x" * 50 + " y", "  ", "One TWO", PROSE]
    h, bounds = text_hash.word_hashes(*text_hash.buffers(pa.array(texts)))
    assert list(np.diff(bounds)) == [len(words(t)) for t in texts]
    by_word = {}
    for t, a in zip(texts, bounds[:-1], strict=True):
        for i, w in enumerate(words(t)):
            assert by_word.setdefault(w, h[a + i]) == h[a + i]
    assert len(set(by_word.values())) == len(by_word)


def test_components(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (300, 301)]
    links += [(rnd.randrange(400, 500), rnd.randrange(400, 500)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        if a != b:
            ra, rb = root.setdefault(a, a), root.setdefault(b, b)
            for k in [k for k, v in root.items() if v in (ra, rb)]:
                root[k] = min(ra, rb)
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
