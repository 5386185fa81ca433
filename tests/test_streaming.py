"""The foreachBatch wrapper: each new file's facilities are extracted once."""

from caregrid.operators.inference import OfflineCompleter
from caregrid.sources.files import read_table
from caregrid.streaming.incremental import extract_stream


def test_micro_batches_extract_once(spark, tmp_path):
    src, silver = str(tmp_path / "bronze"), str(tmp_path / "silver")
    schema = "facility_id string, composite_text string"

    def run():
        q = extract_stream(spark, src, schema, OfflineCompleter(), silver, str(tmp_path / "failures"), str(tmp_path / "work"), str(tmp_path / "ckpt"))
        q.awaitTermination(120)

    spark.createDataFrame([("a", "icu"), ("b", "surgery")], schema).coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([("b", "surgery again"), ("c", "dialysis")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    rows = {r["facility_id"]: r["extraction_json"] for r in read_table(spark, silver).collect()}
    assert set(rows) == {"a", "b", "c"} and "again" not in rows["b"]
