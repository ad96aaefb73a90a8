"""Golden 4-line fixture and the edge cases listed in FIXTURES.md."""

import os
import tempfile

from pyspark.sql import functions as F

from loomtext.functions.text import byte_tokens, hex_to_text
from loomtext.operators import bpe, codec, ngram, pack
from loomtext.sources import tokenizer_store as store
from loomtext.sources.tables import read_text_lines


def _lines(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)],
                                 "doc_id long, line_no int, line string")


def _txt(h):
    return bytes.fromhex(h).decode()


def test_tiny_corpus_merges_ids_decode(spark):
    m = bpe.train_line_bpe(_lines(spark, ["Hello", "Hello Hello", "Help", "Yellow mellow"]),
                           vocab_size=300, min_freq=2)
    assert [(_txt(a), _txt(b), n) for a, b, n in m.merges] == [
        ("e", "l", 6), ("el", "l", 5), ("ell", "o", 5), ("H", "ello", 3), ("ello", "w", 2)]
    assert m.stop_reason == "min_freq" and len(m.vocab) == 265
    assert [i for t, i, k in m.vocab if k == "special"] == [256, 257, 258, 259]
    probe = spark.createDataFrame([("Hello mellow!",)], "line string")
    enc = codec.encode(probe, m, "line", add_bos=True, add_eos=True)
    assert enc.first()["ids"] == [258, 263, 32, 109, 264, 33, 259]
    assert codec.decode(enc, m).first()["text"] == "Hello mellow!"


def test_delta_counts_equal_brute(spark):
    import brute
    texts = ["Hello", "Hello Hello", "Help", "Yellow mellow", "aaaa", "aaa"]
    a = bpe.train_line_bpe(_lines(spark, texts), vocab_size=300, min_freq=1)
    merges, why = brute.train(texts, 300 - 260, min_freq=1)
    assert a.merges == merges and a.stop_reason == why


def test_overlap_and_odd_run(spark):
    m = bpe.train_line_bpe(_lines(spark, ["aaaa"]), vocab_size=261, min_freq=1)
    assert m.merges[0] == ("61", "61", 3)
    m3 = bpe.train_line_bpe(_lines(spark, ["aaa"]), vocab_size=261, min_freq=1)
    assert m3.merges[0] == ("61", "61", 2)
    df = spark.createDataFrame([("aaaa",), ("aaa",)], "line string")
    ids = [r["ids"] for r in codec.encode(df, m3, "line").collect()]
    aa = m3.token_ids()["6161"]
    assert ids == [[aa, aa], [aa, 0x61]]


def test_set_order_vs_rank_order(spark):
    # merges [(b,c),(a,b)]: line mode (set fixpoint) gives ab,c; word mode (rank) a,bc
    vocab = bpe.base_vocab(["<pad>", "<unk>", "<bos>", "<eos>"])
    vocab += [("6263", 260, "merge"), ("6162", 261, "merge")]
    merges = [("62", "63", 1), ("61", "62", 1)]
    line = bpe.BpeModel(merges=merges, vocab=vocab, mode="line")
    word = bpe.BpeModel(merges=merges, vocab=vocab, mode="word")
    df = spark.createDataFrame([("abc",)], "line string")
    assert codec.encode(df, line, "line").first()["ids"] == [261, 0x63]
    assert codec.encode(df, word, "line").first()["ids"] == [0x61, 260]


def test_empty_line_and_multibyte(spark):
    df = spark.createDataFrame([("",), ("Hé",)], "t string")
    got = [r["b"] for r in df.select(byte_tokens("t").alias("b")).collect()]
    assert got == [[], ["48", "C3", "A9"]]


def test_malformed_bytes_on_read(spark):
    d = tempfile.mkdtemp(prefix="loomtext-test-")
    p = os.path.join(d, "bad.txt")
    with open(p, "wb") as f:
        f.write(b"d\xff\xc3e\nok\n")
    lines = [r["line"] for r in read_text_lines(spark, [p]).orderBy("block", "row").collect()]
    assert lines == ["de", "ok"]


def test_malformed_bytes_on_decode(spark):
    df = spark.createDataFrame([("E28241",)], "h string")
    assert df.select(hex_to_text("h").alias("t")).first()["t"] == "�A"


def test_line_endings(spark):
    d = tempfile.mkdtemp(prefix="loomtext-test-")
    p = os.path.join(d, "eol.txt")
    with open(p, "wb") as f:
        f.write(b"a\r\nb\rc\n")
    lines = [r["line"] for r in read_text_lines(spark, [p]).orderBy("block", "row").collect()]
    assert lines == ["a", "b", "c"]


def test_shard_reset(spark):
    sizes = [3, 2, 4, 1]
    enc = spark.createDataFrame([("train", i, 0, [1] * n) for i, n in enumerate(sizes)],
                                "split string, doc_id long, line_no int, ids array<int>")
    off = pack.token_offsets(enc, ["doc_id", "line_no"], blocks=2)
    got = {r["doc_id"]: r["shard_id"] for r in pack.shards_exact(off, 4).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2}


def test_window_packing(spark):
    arrs = [[1, 2, 3], [4, 5], [6, 7, 8, 9], [10]]
    enc = spark.createDataFrame([("train", i, 0, a) for i, a in enumerate(arrs)],
                                "split string, doc_id long, line_no int, ids array<int>")
    off = pack.token_offsets(enc, ["doc_id", "line_no"], blocks=3)
    got = [r["ids"] for r in pack.windows(off, 4).orderBy("window_id").collect()]
    assert got == [[1, 2, 3, 4], [5, 6, 7, 8]]


def test_topk_ties_vs_exact(spark):
    df = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate([2, 1, 1, 0])],
                               "ctx int, token int, logit double")
    assert ngram.top_k_ties(df, 2).count() == 3
    assert ngram.top_k_exact(df, 2).count() == 2


def test_model_save_load_roundtrip(spark):
    m = bpe.train_line_bpe(_lines(spark, ["Hello", "Hello Hello", "Help", "Yellow mellow"]),
                           vocab_size=300, min_freq=2)
    d = tempfile.mkdtemp(prefix="loomtext-model-")
    store.save_model(spark, m, d)
    m2 = store.load_model(spark, d)
    assert m2.merges == m.merges and m2.vocab == m.vocab and m2.mode == m.mode
    labels = {r["id"]: r["label"] for r in spark.read.parquet(os.path.join(d, "vocab")).collect()}
    assert labels[0x48] == "<0x48>" and labels[256] == "<pad>"
    assert labels[260] == "<0x65><0x6c>"


def test_word_artifacts_roundtrip(spark):
    lines = _lines(spark, ["the cat sat on the mat", "the hat", "that thing"])
    m = bpe.train_word_bpe(lines, vocab_size=270, min_freq=2)
    d = tempfile.mkdtemp(prefix="loomtext-words-")
    store.save_word_artifacts(spark, m, d)
    m2 = store.load_word_artifacts(spark, os.path.join(d, "vocab.json"),
                                   os.path.join(d, "merges.txt"), specials=m.specials)
    assert [(a, b) for a, b, _ in m2.merges] == [(a, b) for a, b, _ in m.merges]
    assert sorted(m2.vocab, key=lambda r: r[1]) == sorted(
        [(t, i, k if k != "merge" else "merge") for t, i, k in m.vocab], key=lambda r: r[1])
    df = spark.createDataFrame([("the cat",)], "line string")
    assert codec.encode(df, m2, "line").first()["ids"] == codec.encode(df, m, "line").first()["ids"]


def test_byte_alphabet_rule():
    table = store.byte_alphabet()
    assert len(set(table.values())) == 256
    assert table[ord("A")] == "A" and table[ord(" ")] == chr(256 + 32)
    assert F is not None


def test_token_and_id_lookups(spark):
    m = bpe.train_line_bpe(_lines(spark, ["Hello", "Hello Hello", "Help", "Yellow mellow"]),
                           vocab_size=300, min_freq=2)
    toks = spark.createDataFrame([("48656C6C6F",), ("<eos>",), ("zz",), ("DEAD",)], "token string")
    got = {r["token"]: r["id"] for r in codec.token_to_id(toks, m).collect()}
    assert got["48656C6C6F"] == [263] and got["<eos>"] == [259]
    assert got["DEAD"] == [0xDE, 0xAD]  # a surface of bytes that no merge made
    assert got["zz"] == [257]  # no surface at all: <unk>
    ids = spark.createDataFrame([(263,), (259,)], "id int")
    back = {r["id"]: (r["token"], r["kind"]) for r in codec.id_to_token(ids, m).collect()}
    assert back == {263: ("48656C6C6F", "merge"), 259: ("<eos>", "special")}
    import pytest
    with pytest.raises(ValueError):
        codec.id_to_token(spark.createDataFrame([(999,)], "id int"), m)


def test_bos_eos_only_when_present(spark):
    m = bpe.train_line_bpe(_lines(spark, ["abab"]), vocab_size=258, min_freq=1, specials=["<pad>"])
    assert m.special_id("<bos>") is None
    df = spark.createDataFrame([("ab",)], "line string")
    assert codec.encode(df, m, "line", add_bos=True, add_eos=True).first()["ids"] == [257]


def test_label_byte_conversions(spark):
    from loomtext.functions.text import byte_label, label_to_byte
    df = spark.createDataFrame([("4A",)], "h string")
    r = df.select(byte_label("h").alias("l")).select("l", label_to_byte("l").alias("b")).first()
    assert r["l"] == "<0x4a>" and r["b"] == 0x4A
