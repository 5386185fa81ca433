"""The pipeline end to end on a small folder, and each stage on its own input."""

import os

import pytest

import corpus_pipeline
from caregrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        if name == "line_dedup":
            assert out.count() == docs.count()
        if name == "simhash":
            assert out.select("doc_id").distinct().count() == out.count() <= docs.count()
        docs = out
    assert docs.where("length > 2048").count() == 0 < docs.count()
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, SF).agg({"length": "sum"}).first() == docs.agg({"length": "sum"}).first()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
