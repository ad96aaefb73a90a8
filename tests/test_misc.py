"""Sampling, schedule, SQL UDFs, streaming, quality reports, vectors."""

import math

from pyspark.sql import functions as F

from loomtext import sql as lsql
from loomtext.functions.schedule import cosine_warmup
from loomtext.operators import bpe, ngram, quality, vectors


def test_draw_frequencies(spark):
    ps = {0: 0.5, 1: 0.3, 2: 0.2}
    df = spark.range(20000).select(F.col("id").alias("ctx")) \
        .crossJoin(spark.createDataFrame(list(ps.items()), "token int, prob double"))
    got = ngram.draw(df, "prob", ["ctx"], "token", seed=3).groupBy("token").count().collect()
    freq = {r["token"]: r["count"] / 20000 for r in got}
    for t, p in ps.items():
        assert abs(freq[t] - p) < 0.02


def test_draw_is_reproducible(spark):
    df = spark.createDataFrame([(0, t, p) for t, p in enumerate([0.1, 0.2, 0.7])],
                               "ctx int, token int, prob double")
    a = ngram.draw(df, seed=9).first()["token"]
    b = ngram.draw(df.repartition(3), seed=9).first()["token"]
    assert a == b


def test_softmax_and_topp(spark):
    df = spark.createDataFrame([(0, 0, math.log(0.5)), (0, 1, math.log(0.3)), (0, 2, math.log(0.2))],
                               "ctx int, token int, logit double")
    sm = {r["token"]: r["prob"] for r in ngram.softmax(df).collect()}
    assert abs(sm[0] - 0.5) < 1e-12 and abs(sm[2] - 0.2) < 1e-12
    kept = sorted(r["token"] for r in ngram.top_p(ngram.softmax(df), 0.75).collect())
    assert kept == [0, 1]
    t = ngram.temperature(F.lit(1.0), 0.0)
    assert spark.range(1).select(t.alias("x")).first()["x"] == 1e6


def test_schedule_matches_formula(spark):
    rows = spark.range(0, 300).select("id", cosine_warmup(F.col("id"), 20, 250, 3e-4).alias("lr"))
    lr = {r["id"]: r["lr"] for r in rows.collect()}
    for step, want in ((0, 0.0), (10, 1.5e-4), (20, 3e-4), (135, 1.5e-4), (250, 0.0)):
        assert abs(lr[step] - want) < 1e-12


def test_sql_udfs(spark):
    lines = spark.createDataFrame([(0, 0, "Hello"), (1, 0, "Hello Hello"), (2, 0, "Help"),
                                   (3, 0, "Yellow mellow")], "doc_id long, line_no int, line string")
    m = bpe.train_line_bpe(lines, vocab_size=300, min_freq=2)
    lsql.register(spark, m)
    r = spark.sql("SELECT bpe_encode_bos_eos('Hello mellow!') AS ids, "
                  "bpe_decode(bpe_encode('Hello mellow!')) AS back").first()
    assert r["ids"] == [258, 263, 32, 109, 264, 33, 259] and r["back"] == "Hello mellow!"


def test_hash_split_is_stable(spark):
    df = spark.range(10000).select(F.col("id").alias("doc_id"))
    a = quality.assign_split(df, val_permille=100, seed=1)
    frac = a.where(F.col("split") == "val").count() / 10000
    assert 0.08 < frac < 0.12
    b = quality.assign_split(df.repartition(4), val_permille=100, seed=1)
    assert a.subtract(b).count() == 0


def test_id_range_report(spark):
    enc = spark.createDataFrame([([1, 2, 300],), ([5],)], "ids array<int>")
    vocab = spark.createDataFrame([(i,) for i in range(260)], "id int")
    r = quality.id_range_report(enc, vocab).first()
    assert (r["n_ids"], r["max_id"], r["n_unknown"], r["n_out_of_range"]) == (4, 300, 1, 0)


def test_topk_by_dot_matches_brute(spark):
    import random
    rng = random.Random(1)
    vecs = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    qs = [(0, [rng.uniform(-1, 1) for _ in range(8)]), (1, [rng.uniform(-1, 1) for _ in range(8)])]
    old = vectors.BUCKET_ROWS
    vectors.BUCKET_ROWS = 40  # force many salted buckets
    try:
        got = vectors.top_k_by_dot(df, qs, 5).collect()
    finally:
        vectors.BUCKET_ROWS = old
    for q, qv in qs:
        want = sorted(vecs, key=lambda v: (-sum(a * b for a, b in zip(qv, v[1])), v[0]))[:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query"] == q),
                                            key=lambda r: r["rank"])] == [v[0] for v in want]


def test_streaming_matches_batch(spark, sf):
    from loomtext.plans import q_stream, q_corpus
    s = sorted(map(tuple, q_stream.q_stream_byte_counts(spark, sf).collect()))
    b = sorted(map(tuple, q_corpus.q_byte_freq(spark, sf).collect()))
    assert s == b
    e = q_stream.q_stream_encode(spark, sf).count()
    assert e == q_corpus.q_doc_lines(spark, sf).count()


def test_streaming_bpe_encode_equals_batch(spark, sf):
    from loomtext.operators import codec, corpus
    from loomtext.plans import q_corpus, q_stream
    from loomtext.streaming import ingest
    lines = q_corpus.doc_lines(spark, sf)
    m = bpe.train_line_bpe(lines, vocab_size=270, min_freq=2)
    stream_lines = corpus.split_lines(q_stream.doc_stream(spark, sf), ["doc_id"])
    enc = codec.encode(stream_lines, m, "line", "ids")
    got = ingest.run_to_table(spark, enc.select("doc_id", "line_no", "ids"), "bpe_stream")
    want = codec.encode(lines, m, "line", "ids").select("doc_id", "line_no", "ids")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_small_tables_are_dealt_and_large_ones_never(spark, tmp_path):
    from loomtext.sources.tables import read_table
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    rows = [len(p) for p in read_table(spark, str(tmp_path), "t").rdd.glom().collect()]
    assert len(rows) > 1 and min(rows) > 0
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024b")
    try:
        plan = read_table(spark, str(tmp_path), "t")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "Repartition" not in plan


def test_listed_shards_open_only_their_files(spark, tmp_path, monkeypatch):
    from loomtext.operators import pack
    monkeypatch.setattr(pack, "SHARD_GROUP", 4)
    df = spark.range(400).selectExpr("'train' AS split", "cast(id / 10 as int) AS shard_id", "id AS doc_id",
                                     "0L AS pos", "array(cast(id as int)) AS ids")
    path = str(tmp_path / "s")
    pack.write_shards(df.unionByName(df.withColumn("split", F.lit("val"))), path, ["doc_id"])
    def files(df):
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().apply(0)
        return rows, scan.metrics().apply("numFiles").value()

    every = files(pack.read_shards(spark, path))[1]
    for listed, groups in (([0, 3], 1), ([5, 39, 999], 2), (range(6, 10), 2), ([77], 0)):
        rows, opened = files(pack.read_shards(spark, path, "train", shards=listed))
        assert {r.shard_id for r in rows} == {s for s in listed if s < 40}
        assert len(rows) == 10 * len({s for s in listed if s < 40})
        assert opened <= 2 * groups < every  # a group's rows lie in one or two files
    assert pack.read_shards(spark, path, "train", shards=[]).count() == 0


def test_written_rows_are_counted_by_the_write(spark, tmp_path):
    from loomtext.sources.tables import write_text_counted
    rows = [("a", "x"), ("a", "é"), ("b", None), (None, "zz"), ("c", "")]
    df = spark.createDataFrame(rows, "source string, text string").repartition(3)
    got = write_text_counted(df, str(tmp_path / "t"), ["a", "b", "none"])
    assert got == {"a": (2, 3), "b": (1, 0), "none": (0, 0), None: (2, 2)}
    empty = write_text_counted(df.where("false"), str(tmp_path / "e"), ["a"])
    assert empty == {"a": (0, 0), None: (0, 0)}


def test_rms_norm_with_gain(spark):
    from loomtext.operators.vectors import rms_norm
    df = spark.createDataFrame([([3.0, 4.0],), ([1.0],), (None,)], "embedding array<float>")
    got = [r.normed for r in rms_norm(df, eps=0.0, gain=[2.0, 0.5]).collect()]
    assert got[1] is None and got[2] is None
    assert [round(x, 6) for x in got[0]] == [round(2 * 3 / 12.5 ** .5, 6), round(0.5 * 4 / 12.5 ** .5, 6)]


def test_codec_works_on_parts_of_a_batch(spark, monkeypatch):
    """A batch of many long lines went through numpy whole."""
    import pyarrow as pa

    from loomtext.operators import bpe, codec
    rows = ["the cat " * (i % 900) for i in range(3000)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["line"])
    parts = list(codec._slices(batch))
    assert pa.Table.from_batches(parts).column("line").to_pylist() == rows
    assert len(parts) >= batch.get_total_buffer_size() // codec.SLICE
    assert list(codec._slices(batch.slice(0, 0))) == []
    merges = [("74", "68", 9), ("7468", "65", 8), ("20", "63", 7)]
    vocab = bpe.base_vocab([]) + [(a + b, 256 + i, "merge") for i, (a, b, _) in enumerate(merges)]
    model = bpe.BpeModel(merges=merges, vocab=vocab, specials=[])
    whole = codec.Codec(model).encode_array(batch.column("line")).to_pylist()
    table = spark.createDataFrame(list(enumerate(rows)), "i int, line string").coalesce(1)
    got = codec.encode(table, model).orderBy("i").collect()
    assert [r["ids"] for r in got] == whole


def test_id_to_token_encodes_the_corpus_once(spark, sf):
    """The check for unknown ids and the result each encoded the corpus."""
    from loomtext.plans import q_tokenizer
    plan = q_tokenizer.q_id_to_token(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "InPandas" not in plan
