"""Shuffles, groups and tasks that grow with the input and not faster."""

import numpy as np
from pyspark.sql import functions as F

from caregrid.config import Params
from caregrid.operators import inference as INF
from caregrid.operators import vector as VX
from caregrid.sources import csv_records as CR
from caregrid.sources.bucketed import buckets_for


def test_blocks_of_an_unequal_set_of_files(spark, tmp_path):
    """the second pass over the files that quotes cross must see the blocks of the first."""
    path = str(tmp_path / "csv")
    (tmp_path / "csv").mkdir()
    plain = "\n".join(f"{i},{'x' * 200}" for i in range(30_000))
    for f in range(3):
        (tmp_path / "csv" / f"plain{f}.csv").write_text(f"doc_id,text\n{plain}\n")
    broken = "\n".join(f'{i},"a\nb {"y" * 200}\nc"' for i in range(100_000))
    (tmp_path / "csv" / "broken.csv").write_text(f"doc_id,text\n{broken}\n")
    rows, rejects = CR.read_csv_records(spark, path, ["doc_id", "text"])
    assert rows.count() == 190_000 and rejects.count() == 0
    assert rows.where(F.col("text").contains("\n")).count() == 100_000


def corpus(spark, n):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(f"f{i:04d}", [float(x) for x in rng.normal(size=4)], "S", "C", "hospital", 0.5) for i in range(n)],
                                 "facility_id string, embedding array<float>, address_state string, address_city string, facility_type string, trust_score double")


def test_candidates_do_not_grow_with_tasks(spark):
    """Every task handed on k rows of each query; now every part of the corpus does, cut by bytes."""
    vt = corpus(spark, 300).repartition(12)
    qs = vt.select(F.substring("facility_id", 2, 4).cast("long").alias("query_id"), F.col("embedding").alias("query_vec"),
                   *[F.lit(None).cast("string").alias(c) for c in ("state", "city", "facility_type")], F.lit(None).cast("double").alias("min_trust_score"))
    params = Params(block_queries=50)
    assert VX.candidates(qs, vt, 5, True, params).count() == 300 * 5
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(VX.search(qs, vt, 5))
    assert key(VX.search(qs, vt, 5, params=params)) == want and len(want) == 1500
    assert key(VX.search(qs, vt, 5, params=Params(block_queries=50, max_broadcast_bytes=2000))) == want


def test_calls_hold_few_rows_as_objects(spark, monkeypatch):
    """rows reach the model a few at a time, whatever the Arrow batch, and the other columns pass unchanged."""
    monkeypatch.setattr(INF, "CALL_ROWS", 7)
    df = spark.range(50).select(F.concat(F.lit("f"), "id").alias("facility_id"), F.struct("id", F.array(F.lit(None).cast("string"))).alias("nested"),
                                INF.messages("s", F.concat(F.lit("text "), F.col("id"))).alias("messages")).coalesce(1)

    class Model:
        def __call__(self, msgs):
            if msgs[1]["content"].endswith("3"):
                raise ValueError("no")
            return {"content": msgs[1]["content"], "prompt_tokens": 2}

    out = INF.complete(df, "messages", Model(), concurrency=3)
    got = {r["facility_id"]: r for r in out.collect()}
    assert len(got) == 50 and got["f12"]["content"] == "text 12" and got["f12"]["nested"]["id"] == 12 and got["f12"]["completion_tokens"] == 0
    assert got["f13"]["call_error"] == "ValueError: no" and got["f13"]["content"] is None
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_embedding_passes_other_columns_as_arrow(spark):
    df = spark.createDataFrame([(1, "icu ward", ("a", [1, 2])), (2, None, None)], "id long, t string, n struct<x:string,y:array<int>>")
    out = VX.embed_texts(df, "t", VX.HashingEmbedder(8), 8, batch_rows=1)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["n"]["y"] == [1, 2] and rows[2]["n"] is None and rows[2]["embedding"] == [0.0] * 8
    assert abs(sum(x * x for x in rows[1]["embedding"]) - 1) < 1e-6


def test_a_bucket_of_wide_rows_fits_in_a_task():
    """a task sorted up to a million rows of Gold."""
    assert buckets_for(900_000) == 9 and buckets_for(5_400_000) == 54 and buckets_for(1) == 1
