"""Operator 12 against a trie built turn by turn, over few and many partitions."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, depth long"


def _digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        own.setdefault(c, []).append((turn is not None, turn or 0, role or "", _digest(role or "", text or ""),
                                      text or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(t)] for c, t in own.items()}
    members, ends = {}, {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if c is not None else 0
        base = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), []) if c is not None else []
        seq = tuple(base[:h] + t[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    low = P.NO_ID
    def least(cs):
        return min(cs, key=lambda c: low if c is None else c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below)
    out = []
    for p, cs in members.items():
        ids = ",".join("" if c is None else str(c)
                       for c in sorted(ends.get(p, []), key=lambda c: low if c is None else c))
        out.append((least(cs), len(p), least(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])),
                    leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in P.trie_nodes(df, **kw).collect()), key=repr)


def conversations(seed, n, words, depth):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        c = pick.randrange(-150, 900)
        if any(r[0] == c for r in rows):
            continue
        for t in range(pick.randrange(0, depth) + 1):
            rows.append((c, t, "assistant" if t % 2 else "user", pick.choice(words), "k", 1, 2))
    return rows


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_trie_equals_brute_force(spark, parts):
    rows = conversations(parts, 120, ["a", "bb", "", "ccc"], 6)
    rows += [(None, 0, "user", "a", "k", 1, 2), (None, None, None, None, "k", 1, 2)]
    rows += [(1000, 0, "user", "tie", "k", 1, 2), (1000, 0, "user", "eit", "k", 1, 2)] * 2
    rows += [(2000, t, "user", "long", "k", 1, 2) for t in range(300)]
    rows += [(2001, t, "user", "long", "k", 1, 2) for t in range(299)]
    assert found(spark, rows, partitions=parts) == brute(rows)


def test_equal_conversations_over_many_partitions(spark):
    rows = [(c, t, "user", "same" if c % 3 else f"{c % 2}", "k", 1, 2) for c in range(10_000, 10_300) for t in range(2)]
    assert found(spark, rows, partitions=20) == brute(rows)


def test_no_conversations(spark):
    assert found(spark, []) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), min_size=1, max_size=40), st.integers(1, 12))
def test_contracted_forests_equal_one_forest(seqs, width):
    """The forest merged over blocks gives the nodes of the forest over all items."""
    def turn(x):
        return bytes([x]) * P.DIGEST

    convs = sorted((b"".join(map(turn, s)), i, [x + 1 for x in s]) for i, s in enumerate(seqs))

    def grown(part):
        batch = P.pa.table({"conv_id": [c for _, c, _ in part], "key": [k for k, _, _ in part],
                            "sizes": [s for _, _, s in part]})
        items, ids = P._runs([batch])
        edges = [P.common_depth(a["key"], b["key"]) for a, b in zip(items, items[1:])]
        return items, edges

    def facts(nodes):
        return sorted((n["depth"], n["owner"], n["n"], n["kids"], n["leaves"], n["saved"]) for n in nodes)

    forest = P.Forest(*grown(convs), 0)
    forest.merge(True)
    nodes, tables = [], []
    for part, at in enumerate(range(0, len(convs), width)):
        f = P.Forest(*grown(convs[at:at + width]), 0)
        f.merge(False)
        tables.append(P._record(f.contracted(), part))
        nodes += f.nodes
    parts, level = len(tables), 1
    tables = P.pa.Table.from_batches(tables).to_pylist()
    while True:
        parts = -(-parts // P.FAN)
        merged = []
        for block in range(parts):
            mine = [r for r in tables if r["part"] // P.FAN == block]
            if mine:
                merged += P._merge(parts == 1, level)(P.pa.Table.from_pylist(mine, schema=P._ARROW)).to_pylist()
        nodes += [r for r in merged if r["kind"] == "node"]
        tables = [r for r in merged if r["kind"] == "item"]
        if parts == 1:
            break
        level += 1
    assert facts(nodes) == facts(forest.nodes)
