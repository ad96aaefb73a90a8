"""The pipeline's stages against brute force, and the entry's registration."""

import re

import corpus_pipeline
import __spark_entry__ as entry

from conftest import PROSE, texts_of  # noqa: I001
from test_native import ITEMS, brute_contamination, low
from test_packing_and_near import brute_near


def test_queries_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert "pipeline" in names


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_exact_and_near_stages(spark, edges, docs, sf, no_docs):
    for df in (edges, docs):
        exact = stage("exact_dedup")(spark, df, sf).cache()
        assert exact.columns == df.columns
        assert len({low(t) for _, t in texts_of(df)}) == exact.count()
        near = stage("near_dedup")(spark, exact, sf)
        assert near.columns == df.columns
        want = {i for i, _, c, kept in brute_near(texts_of(exact), 5) if i == c}
        assert {i for i, _ in texts_of(near)} == want
    assert stage("near_dedup")(spark, no_docs, sf).count() == 0


def test_benchmark_stage(spark, edges, sf, tmp_path):
    spark.createDataFrame([x for x in ITEMS if x[0] is not None], "item_id long, text string") \
        .write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = stage("decontamination")(spark, edges, str(tmp_path))
    bad = {i for i, _, hit, _, _ in brute_contamination(texts_of(edges), [x for x in ITEMS if x[0] is not None]) if hit}
    assert kept.columns == edges.columns
    assert texts_of(kept) == [(i, t) for i, t in texts_of(edges) if i not in bad]


def test_rows_with_shared_or_null_ids(spark, tmp_path):
    """Each row stays or goes by its own text, whatever other rows have its id."""
    clean = ["alpha beta gamma delta", "one two three four five six"]
    group = [PROSE, PROSE + " x", PROSE + " y"]
    for ids in ([None] * 5, [7] * 5, [None, 7, None, None, 7]):
        df = spark.createDataFrame(list(zip(ids, clean + group, strict=True)), "doc_id long, text string").repartition(3)
        near = texts_of(stage("near_dedup")(spark, df, ""))
        assert {t for _, t in near} >= set(clean)
        assert sum(t in group for _, t in near) == 1
        if 7 in ids:
            assert all(i == 7 for i, t in near if t in group)
        spark.createDataFrame([(1, PROSE)], "item_id long, text string") \
            .write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        kept = stage("decontamination")(spark, df, str(tmp_path))
        assert kept.columns == ["doc_id", "text"]
        assert sorted(t for _, t in texts_of(kept)) == clean


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
    ends = {}
    for r in rows:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert all(ends[s] == 2048 for s in range(len(ends) - 1))


def test_columns_of_any_name_come_back(spark, sf, tmp_path):
    """Names that the stages use inside keep the input's values."""
    names = ["_sha", "_jk", "_n", "_text", "_score", "_row", "_rid", "_norm", "r", "i", "component_id", "kept", "_in0"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(
        [PROSE, PROSE.upper(), PROSE + " x", "other words stand here alone", None, ITEMS[0][1]])]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)], labels).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([x for x in ITEMS if x[0] is not None], "item_id long, text string") \
        .write.parquet(f"{tmp_path}/benchmark.parquet")
    given = {tuple(r) for r in rows}
    for name in ("quality", "exact_dedup", "near_dedup", "decontamination"):
        out = stage(name)(spark, df, str(tmp_path))
        assert out.columns == df.columns
        got = {tuple(r) for r in out.collect()}
        assert got and got <= given, name
