"""The pipeline's stages, one after the other, against brute force on their own input."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).checkpoint()
        seen[name] = docs
        after = docs.select("doc_id").distinct().collect()
        assert {r.doc_id for r in after} <= set(before)
        if name != "pack_sequences":
            assert docs.columns == list(pipeline.COLUMNS)
            assert all(tuple(before[r.doc_id]) == tuple(r) for r in docs.collect())
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "quality_classifier", "minhash_near_dedup", "mix_sources", "pack_sequences"]
    packed = seen["pack_sequences"].toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in seen["mix_sources"].collect()}
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
