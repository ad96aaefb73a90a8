"""Operator 13 against a tree built level by level in plain Python."""

import hashlib
import zlib

import pytest

from loomtext.llm.merkle_manifest import manifest



LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i:i + 16]) for i in range(0, len(last), 16)])
    return levels


def climb(levels, at):
    for nodes in levels[:-1]:
        start = at - at % 16
        yield "".join(nodes[start:at]), "".join(nodes[at + 1:start + 16])
        at //= 16


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    tops = tree([trees[s][-1][0] for s in names])
    out = []
    for at_source, s in enumerate(names):
        for at, (*_, h, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            path = list(climb(trees[s], at)) + list(climb(tops, at_source))
            f = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                f = leaf(r[:4] + (r[4].translate(LOWER),))
            for left, right in path:
                f = sha(left, f, right)
            root = tops[-1][0]
            out.append((r[0], h, trees[s][-1][0], root, sha(*[x for p in path for x in p]), f, f == root))
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted((tuple(r) for r in manifest(df, **kw).collect()), key=repr)


def test_edge_rows(spark, edges):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in edges.collect()]
    assert found(edges) == brute(rows)


@pytest.mark.parametrize("parts", [1, 13])
def test_sources_of_many_sizes(spark, parts):
    sizes = {None: 1, "": 16, "a": 17, "B": 256, "é": 257, "hot": 4500, "z": 2}
    sizes |= {f"s{i}": 1 + i % 3 for i in range(300)}
    rows = [(i * 7 - 50, s, None if i % 3 else "en", i, f"Text {i} OF {s}" if i % 2 else f"text {i}")
            for s, n in sizes.items() for i in range(n)]
    rows += [(None, "hot", None, None, None)] * 40
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert found(spark.createDataFrame(rows, schema).repartition(5), partitions=parts) == brute(rows)


def test_three_strata(spark):
    df = spark.range(0, 66_000, 1, 8).selectExpr(
        "id AS doc_id", "'one' AS source", "'en' AS lang", "id % 10 AS n_chars", "concat('T', id) AS text",
        "1 AS pos", "2 AS g", "3 AS hash")
    want = brute([(i, "one", "en", i % 10, f"T{i}") for i in range(66_000)])
    assert found(df) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 3


def test_no_rows(no_docs):
    assert found(no_docs) == []
