"""A micro-batch of few files is spread over the cluster."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from loomtext.plans import q_stream


def test_files_that_arrive_hold_several_row_groups(spark, tmp_path, monkeypatch):
    pick = random.Random(5)
    text = ["".join(pick.choices("abcdefgh \n", k=50_000)) for _ in range(40)]
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    for i in range(2):
        pq.write_table(pa.table({"doc_id": pa.array(range(i * 400, i * 400 + 400), pa.int64()),
                                 "text": [f"{i} {j} " + text[j % 40] for j in range(400)]}), folder / f"{i}.parquet")
    monkeypatch.setattr(q_stream, "ROW_GROUP", 4 << 20)
    monkeypatch.setattr(q_stream.S, "file_stream", lambda spark, path, schema, **kw: path)
    monkeypatch.setattr(q_stream, "read_table", lambda spark, d, name, cols: spark.read.parquet(
        f"{d}/{name}.parquet").select(*cols).coalesce(2))
    path = q_stream.arriving_files(spark, str(tmp_path))
    files = spark.read.parquet(path).inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in files]
    assert len(files) == 2 and min(groups) >= 4
    assert spark.read.parquet(path).count() == 800


def test_the_encoder_hands_back_no_text_that_nobody_reads(spark):
    from loomtext.operators import bpe, codec
    lines = spark.createDataFrame([(1, 0, "the the"), (2, 0, None), (3, 1, "hé")], "doc_id long, line_no int, line string")
    model = bpe.train_line_bpe(lines.where("line is not null"), vocab_size=264)
    for m in (model, bpe.train_word_bpe(lines.where("line is not null"), vocab_size=264)):
        kept = codec.encode(lines, m, "line", "ids")
        bare = codec.encode(lines, m, "line", "ids", keep_text=False)
        assert kept.columns == ["doc_id", "line_no", "line", "ids"] and bare.columns == ["doc_id", "line_no", "ids"]
        assert sorted(map(str, kept.drop("line").collect())) == sorted(map(str, bare.collect()))
