"""J8 upsert, A2 keep-first dedup under a hot key, J3 resume."""

from caregrid.operators.dedup import dedup_keep_first
from caregrid.operators.upsert import merge, pending, update_matched, upsert_table


def test_upsert_replaces_and_adds(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "id int, v string, o int")
    upd = spark.createDataFrame([(2, "B2", 1), (4, "d", 1)], "id int, v string, o int")
    path = str(tmp_path / "t")
    upsert_table(spark, base, path, "id", "o")
    out = {r["id"]: r["v"] for r in upsert_table(spark, upd, path, "id", "o").collect()}
    assert out == {1: "a", 2: "B2", 3: "c", 4: "d"}
    # idempotent
    again = {r["id"]: r["v"] for r in upsert_table(spark, upd, path, "id", "o").collect()}
    assert again == out


def test_last_in_batch_wins(spark):
    upd = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id int, v string, o int")
    assert [r["v"] for r in merge(None, upd, "id", "o").collect()] == ["y"]


def test_keep_first_hot_key(spark):
    rows = [(0 if i % 3 == 0 else i, i, f"v{i}") for i in range(3000)]  # a third share key 0
    df = spark.createDataFrame(rows, "k int, ord int, v string").repartition(8)
    out = {r["k"]: r["v"] for r in dedup_keep_first(df, ["k"], "ord").collect()}
    assert out[0] == "v0" and len(out) == 2001


def test_resume_and_matched_update(spark):
    src = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    done = spark.createDataFrame([(2,)], "id int")
    assert sorted(r[0] for r in pending(src, done, "id").collect()) == [1, 3]
    tgt = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, v string, s double")
    upd = spark.createDataFrame([(2, "B", 9.0), (5, "new", 0.0)], "id int, v string, s double")
    got = sorted(tuple(r) for r in update_matched(tgt, upd, "id", ["v", "s"]).collect())
    assert got == [(1, "a", 1.0), (2, "B", 9.0)]
