"""Sharding, decontamination and exact dedup against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import LOWER, PROSE, texts_of  # noqa: I001
from loomtext.llm import chunk_dedup, decontam, rendezvous


def low(t):
    return (t or "").translate(LOWER)


@pytest.mark.parametrize("chunk_hash", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
@pytest.mark.parametrize("table", ["edges", "docs"])
def test_exact_groups(request, table, chunk_hash):
    """Also with a hash of three values: identifiers are told apart by the text."""
    df = request.getfixturevalue(table)
    rows = chunk_dedup.exact_groups(df, chunk_hash=chunk_hash).collect()
    groups = defaultdict(list)
    for i, t in texts_of(df):
        groups[low(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_drop_exact_copies(edges, no_docs):
    kept = chunk_dedup.drop_exact_copies(edges)
    assert kept.columns == edges.columns
    rows = texts_of(kept)
    assert len(rows) == len({low(t) for _, t in texts_of(edges)})
    assert (2, PROSE.upper()) in rows and (1, PROSE) not in rows
    assert chunk_dedup.drop_exact_copies(no_docs).count() == 0
    assert chunk_dedup.exact_groups(no_docs).count() == 0


def test_chunks_restore_text(edges):
    joined = edges.select(F.coalesce("text", F.lit("")).alias("t")).select(
        "t", F.array_join(chunk_dedup.chunks(F.col("t")), "").alias("j"))
    assert joined.where("t <> j").count() == 0


def test_shards(edges, docs, no_docs):
    for df in (edges, docs):
        rows = rendezvous.shard_documents(df).collect()
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts_of(df))
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rendezvous.shard_documents(no_docs).count() == 0


def test_shard_weights(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    n = Counter(r.shard for r in rendezvous.shard_documents(keys, [1.0, 3.0]).collect())
    assert abs(n[1] / 20000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        rendezvous.rendezvous(F.col("doc_id"), [1.0, 0.0])


def brute_contamination(docs, items, window=10):
    pat = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wins = defaultdict(set)
    for i, t in items:
        w = pat.findall(low(t))
        for a in range(max(len(w) - window, 0) + 1 if w else 0):
            wins[tuple(w[a:a + window])].add(str(i))
    lens = {len(w) for w in wins}
    out = Counter()
    for i, t in docs:
        w = pat.findall(low(t))
        hit, found = set(), set()
        for n in lens:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a:a + n])) in wins:
                    hit |= set(range(a, a + n))
                    found |= wins[x]
        out[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())] += 1
    return out


ITEMS = [(1, PROSE), (2, "word"), (3, None), (4, "!!"), (10, "lazy dog"), (10, "lazy dog"),
         (11, " ".join(PROSE.split()[4:15])), (None, "brew a potion")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination(spark, edges, docs, no_docs, sf, broadcast, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", 10 ** 6 if broadcast else 0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    bench_rows = [(r.item_id, r.text) for r in bench.collect()]
    cases = [(edges, items, [x for x in ITEMS if x[0] is not None])]
    cases += [(docs, bench, bench_rows), (edges, items.limit(0), []), (no_docs, items, ITEMS)]
    for d, b, rows in cases:
        got = decontam.contamination(d, b.where("item_id is not null")).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) \
            == brute_contamination(texts_of(d), rows)
        assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_contamination_by_item_without_id(spark, edges):
    items = spark.createDataFrame([(None, "brew a potion")], "item_id long, text string")
    got = decontam.contamination(edges, items).where("contaminated").collect()
    assert {r.n_hit for r in got} == {3, 6} and {r.n_items for r in got} == {0}
