"""Iterative / order-dependent operators against plain-Python brute force."""

import random

import pytest
import regex
from pyspark.sql import functions as F

import brute
from loomtext.functions.text import WORD_PATTERN, byte_ids
from loomtext.operators import bpe, codec, corpus, pack
from loomtext.plans import q_pack
from loomtext.sources.tables import read_table


@pytest.fixture(scope="module")
def lines(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return corpus.split_lines(docs, ["doc_id"]).cache()


@pytest.fixture(scope="module")
def local_lines(lines):
    return [r["line"] for r in lines.orderBy("doc_id", "line_no").collect()]


@pytest.fixture(scope="module")
def line_model(lines):
    return bpe.train_line_bpe(lines, vocab_size=260 + 12, min_freq=2)


def test_line_bpe_matches_brute(line_model, local_lines):
    merges, _ = brute.train(local_lines, 12)
    assert line_model.merges == merges


def test_line_encode_matches_brute(line_model, lines, local_lines):
    ids = line_model.token_ids()
    got = [r["ids"] for r in codec.encode(lines, line_model, "line")
           .orderBy("doc_id", "line_no").collect()]
    want = [brute.encode_line(t, line_model.merges, ids) for t in local_lines]
    assert got == want


def test_roundtrip_whole_corpus(line_model, lines):
    from loomtext.operators.quality import roundtrip
    assert roundtrip(lines, line_model, "line").where(~F.col("ok")).count() == 0


def test_word_encode_matches_brute(spark, lines, local_lines):
    m = bpe.train_word_bpe(lines, vocab_size=260 + 20, min_freq=2)
    ids = m.token_ids()
    got = [r["ids"] for r in codec.encode(lines, m, "line").orderBy("doc_id", "line_no").collect()]
    pat = regex.compile(WORD_PATTERN.replace("(?U)", ""))
    want = [[i for w in pat.findall(t) for i in brute.encode_word(w, m.merges, ids)]
            for t in local_lines]
    assert got == want


def test_word_bpe_merges_never_cross_words(spark, lines):
    m = bpe.train_word_bpe(lines, vocab_size=260 + 30, min_freq=2)
    for a, b, _ in m.merges:
        s = bytes.fromhex(a + b).decode("utf-8", errors="replace")
        # a merged token is a prefix/whole of one pre-token: at most a leading space
        assert " " not in s.strip(" ") or s.strip() == ""


def test_word_pretokens_match_python_regex(spark, lines, local_lines):
    got = [r["w"] for r in lines.orderBy("doc_id", "line_no")
           .select(F.regexp_extract_all("line", F.lit(WORD_PATTERN), 0).alias("w")).collect()]
    pat = regex.compile(WORD_PATTERN.replace("(?U)", ""))
    assert got == [pat.findall(t) for t in local_lines]


@pytest.mark.parametrize("S,blocks", [(1000, 3), (5000, 8), (50_000, 2), (7, 5)])
def test_exact_shards_match_sequential_pass(spark, lines, local_lines, S, blocks):
    enc = lines.select(F.lit("train").alias("split"), "doc_id", "line_no",
                       byte_ids("line").alias("ids"))
    off = pack.token_offsets(enc, ["doc_id", "line_no"], blocks=blocks)
    got = [r["shard_id"] for r in pack.shards_exact(off, S).orderBy("doc_id", "line_no").collect()]
    sizes = [len(t.encode()) for t in local_lines]
    want = [0] * len(sizes)
    for k, members in enumerate(brute.shard_sizes(sizes, S)):
        for i in members:
            want[i] = k
    assert got == want


def test_shard_properties(spark, sf):
    sh = pack.shards_exact(q_pack.byte_offsets(spark, sf), 20_000)
    tot = pack.shard_totals(sh).collect()
    per_split = {}
    for r in tot:
        per_split.setdefault(r["split"], []).append((r["shard_id"], r["n_tokens"]))
    all_tokens = q_pack.byte_offsets(spark, sf).groupBy("split").agg(F.sum("n")).collect()
    for r in all_tokens:
        shards = sorted(per_split[r["split"]])
        assert sum(n for _, n in shards) == r[1]
        assert [s for s, _ in shards] == list(range(len(shards)))
        assert all(n >= 20_000 for _, n in shards[:-1])


def test_windows_are_stream_prefix(spark, sf):
    off = q_pack.byte_offsets(spark, sf)
    wins = pack.windows(off, 64).where(F.col("split") == "train").orderBy("window_id").collect()
    stream = [i for r in off.where(F.col("split") == "train").orderBy("start").collect()
              for i in r["ids"]]
    flat = [i for w in wins for i in w["ids"]]
    assert flat == stream[:len(flat)] and len(stream) - len(flat) < 64


def test_overlapping_windows(spark):
    enc = spark.createDataFrame([("train", i, 0, a) for i, a in
                                 enumerate([[1, 2, 3], [4, 5], [6, 7, 8, 9], [10]])],
                                "split string, doc_id long, line_no int, ids array<int>")
    off = pack.token_offsets(enc, ["doc_id", "line_no"], blocks=2)
    got = [r["ids"] for r in pack.windows(off, 4, stride=2).orderBy("window_id").collect()]
    assert got == [[1, 2, 3, 4], [3, 4, 5, 6], [5, 6, 7, 8], [7, 8, 9, 10]]


def test_repartition_invariance(spark, lines):
    a = bpe.train_line_bpe(lines, vocab_size=266, min_freq=2)
    b = bpe.train_line_bpe(lines.repartition(7), vocab_size=266, min_freq=2)
    assert a.merges == b.merges
    enc = lines.select(F.lit("train").alias("split"), "doc_id", "line_no",
                       byte_ids("line").alias("ids"))
    s1 = pack.shards_exact(pack.token_offsets(enc, ["doc_id", "line_no"], blocks=4), 3000)
    s2 = pack.shards_exact(pack.token_offsets(enc.repartition(5), ["doc_id", "line_no"], blocks=9), 3000)
    k = ["doc_id", "line_no", "shard_id"]
    assert sorted(map(tuple, s1.select(*k).collect())) == sorted(map(tuple, s2.select(*k).collect()))


def test_random_shard_inputs(spark):
    rng = random.Random(5)
    for trial in range(3):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(5, 60))]
        S = rng.randint(3, 25)
        enc = spark.createDataFrame([("t", i, 0, [1] * n) for i, n in enumerate(sizes)],
                                    "split string, doc_id long, line_no int, ids array<int>")
        off = pack.token_offsets(enc, ["doc_id", "line_no"], blocks=rng.randint(1, 6))
        got = [r["shard_id"] for r in pack.shards_exact(off, S).orderBy("doc_id").collect()]
        want = [0] * len(sizes)
        for k, members in enumerate(brute.shard_sizes(sizes, S)):
            for i in members:
                want[i] = k
        assert got == want, (sizes, S)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_batched_training_equals_brute_on_random_corpora(spark, seed):
    rng = random.Random(seed)
    alphabet = "abcd "[: rng.randint(3, 5)]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
             for _ in range(rng.randint(5, 40))]
    lines = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)],
                                  "doc_id long, line_no int, line string")
    want, why = brute.train(texts, 30, min_freq=2)
    for kw in ({"hot": 16}, {"hot": 1}):
        m = bpe.train_line_bpe(lines, vocab_size=260 + 30, min_freq=2, **kw)
        assert m.merges == want, kw
        assert m.stop_reason == why or (why == "vocab_full" and len(m.merges) == 30)


def test_batched_training_more_merges_on_corpus(spark, lines, local_lines):
    m = bpe.train_line_bpe(lines, vocab_size=260 + 40, min_freq=2, hot=64)
    want, _ = brute.train(local_lines, 40)
    assert m.merges == want


def test_grouped_prefix_sum_matches_pandas(spark):
    import pandas as pd
    from loomtext.operators.positions import exclusive_prefix_sum
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", "c"]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, n long")
    got = exclusive_prefix_sum(df, "n", ["g", "k"], out_col="s", blocks=7, group_col="g")
    got = {(r["g"], r["k"]): r["s"] for r in got.collect()}
    pdf = pd.DataFrame(rows, columns=["g", "k", "n"]).sort_values(["g", "k"])
    pdf["s"] = pdf.groupby("g")["n"].cumsum() - pdf["n"]
    assert got == {(g, k): s for g, k, s in pdf[["g", "k", "s"]].itertuples(index=False)}
    plain = exclusive_prefix_sum(df, "n", ["g", "k"], out_col="s", blocks=5)
    pdf["t"] = pdf["n"].cumsum() - pdf["n"]
    assert {(r["g"], r["k"]): r["s"] for r in plain.collect()} == \
        {(g, k): t for g, k, t in pdf[["g", "k", "t"]].itertuples(index=False)}


def test_encode_inside_blocks_equals_encode_before(spark, lines, line_model):
    src = lines.select(F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"),
                       "doc_id", "line_no", "line")
    before = pack.token_offsets(codec.encode(src, line_model, "line", "ids").drop("line"),
                                ["doc_id", "line_no"], blocks=5)
    inside = pack.token_offsets(src, ["doc_id", "line_no"], blocks=3,
                                encode=lambda d: codec.encode(d, line_model, "line", "ids").drop("line"))
    k = ["split", "doc_id", "line_no", "start", "n"]
    assert sorted(map(tuple, before.select(*k).collect())) == sorted(map(tuple, inside.select(*k).collect()))
    a = pack.shards_exact(before, 3000).select("doc_id", "line_no", "shard_id")
    b = pack.shards_exact(inside, 3000).select("doc_id", "line_no", "shard_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("fan,width", [(2, 1), (3, 2), (16, 8)])
def test_exact_shards_tree_matches(spark, monkeypatch, fan, width):
    """Small blocks and fan-out force several tree levels; empty middle lines,
    constant and random sizes, lines longer than a block."""
    monkeypatch.setattr(pack, "FAN", fan)
    monkeypatch.setattr(pack, "BLOCK_SHARDS", width)
    rng = random.Random(fan)
    cases = [([4] * 1300, 11), ([4 if not 400 <= i < 800 else 0 for i in range(1300)], 11),
             ([rng.randint(0, 9) for _ in range(700)], 13), ([1, 200, 1, 1, 300, 2, 0, 500] * 12, 17), ([3], 50)]
    for sizes, S in cases:
        rows = [("train" if i % 7 else "val", i, list(range(n))) for i, n in enumerate(sizes)]
        off = pack.token_offsets(spark.createDataFrame(rows, "split string, doc_id int, ids array<int>"), ["doc_id"])
        got = {r["doc_id"]: (r["shard_id"], r["pos"]) for r in pack.shards_exact(off, S).collect()}
        want = {}
        for split in ("train", "val"):
            own = [i for s, i, _ in rows if s == split]
            for k, members in enumerate(brute.shard_sizes([sizes[i] for i in own], S)):
                at = 0
                for m in members:
                    want[own[m]] = (k, at)
                    at += sizes[own[m]]
        assert got == want
