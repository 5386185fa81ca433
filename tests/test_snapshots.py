"""Versioned tables: nothing is lost wherever a writer dies, writers conflict loudly, merges rewrite few files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from caregrid.operators import upsert as UP
from caregrid.sources import snapshots as S
from caregrid.sources.files import read_table, register_views, table_exists

ROWS = "id long, v string, o long"


def contents(df):
    return {r["id"]: r["v"] for r in df.select("id", "v").collect()}


def base(spark, path, n=400, rows_per_file=25):
    S.upsert(spark, spark.range(n).selectExpr("id", "'a' v", "0L o"), path, "id", "o", rows_per_file)
    return dict.fromkeys(range(n), "a")


class Died(Exception):
    pass


STEPS = ["_write_data", "_describe", "_commit", "create_if_absent", "files_with"]


@pytest.mark.parametrize(("write", "step", "after"), [
    (w, s, a) for w, steps in (("upsert", STEPS), ("replace", STEPS[:4]), ("update", STEPS[2:3])) for s in steps for a in (False, True)])
def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch, write, step, after):
    path = str(tmp_path / "t")
    old = base(spark, path, 40, 10)
    batch = spark.createDataFrame([(3, "b", 1), (99, "new", 1)], ROWS)

    def go():
        if write == "upsert":
            S.upsert(spark, batch, path, "id", "o")
        elif write == "replace":
            UP.replace_table(spark, read_table(spark, path).where("id < 20"), path)
        else:
            S.update(spark, batch.select("id", "v"), path, "id", ["v"])

    want = {"upsert": old | {3: "b", 99: "new"}, "replace": {k: v for k, v in old.items() if k < 20}, "update": old | {3: "b"}}[write]
    real = getattr(S, step)

    def dying(*args):
        if after:
            real(*args)
        raise Died

    monkeypatch.setattr(S, step, dying)
    with pytest.raises(Died):
        go()
    monkeypatch.setattr(S, step, real)
    committed = after and step in ("create_if_absent", "_commit")
    assert contents(read_table(spark, path)) == (want if committed else old)
    go()  # a later run takes up where the newest version is
    assert contents(read_table(spark, path)) == want


def test_a_process_that_is_killed_loses_nothing(spark, tmp_path):
    import subprocess
    import sys

    path, repo = str(tmp_path / "t"), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    old = base(spark, path, 40, 10)
    code = (f"import os, sys; sys.path.insert(0, {repo!r})\n"
            "from caregrid.session import build_session\n"
            "from caregrid.sources import snapshots as S\n"
            "s = build_session(master='local[1]', shuffle_partitions=1)\n"
            "S._commit = lambda *a: os._exit(9)\n"
            f"S.upsert(s, s.range(30, 50).selectExpr('id', \"'b' v\", '1L o'), {path!r}, 'id', 'o')\n")
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=300).returncode == 9
    assert len(os.listdir(f"{path}/_data")) == 2 and contents(read_table(spark, path)) == old


def test_two_writers_conflict_loudly(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    old = base(spark, path, 40, 10)
    commit = S._commit

    def late(*args):
        monkeypatch.setattr(S, "_commit", commit)
        S.upsert(spark, spark.createDataFrame([(1, "first", 1)], ROWS), path, "id", "o")  # another writer, in between
        return commit(*args)

    monkeypatch.setattr(S, "_commit", late)
    with pytest.raises(S.CommitConflict):
        S.upsert(spark, spark.createDataFrame([(2, "second", 1)], ROWS), path, "id", "o")
    assert contents(read_table(spark, path)) == old | {1: "first"}
    assert not S.create_if_absent(spark, S._version_file(path, 1), "{}")
    assert S.versions(spark, path) == [1, 2]


def test_fifty_keys_touch_few_of_two_hundred_files(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(1)
    S.upsert(spark, spark.range(1_000_000).selectExpr("sha1(cast(id as string)) id", "'a' v", "0L o"), path, "id", "o", 5000)
    h = S.head(spark, path)
    n = S.files(spark, path, h).count()
    assert 200 <= n <= 210
    keys = spark.createDataFrame([(rng.randrange(1_000_000),) for _ in range(50)], "n long").selectExpr("sha1(cast(n as string)) id")
    touched = S.files_with(spark, path, h, keys)
    before = set(read_table(spark, path).inputFiles())
    version = S.upsert(spark, keys.selectExpr("id", "'b' v", "1L o"), path, "id", "o", 5000)
    out = read_table(spark, path)
    assert version == 2 and out.count() == 1_000_000 and out.where("v = 'b'").count() == keys.distinct().count()
    assert len(before - set(out.inputFiles())) == len(touched) <= 50
    absent = spark.range(50).selectExpr("concat(sha1(cast(-1 - id as string)), 'x') id")
    assert S.files_with(spark, path, h, absent) == []


def test_filters_find_all_keys_and_few_others(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for part in range(4):  # files that overlap in their range of keys, so that the filters alone tell them apart
        S.append(spark, spark.range(5000).selectExpr(f"id * 4 + {part} id", "'a' v", "0L o"), path) if part else S.replace(
            spark, spark.range(5000).selectExpr("id * 4 id", "'a' v", "0L o"), path, "id", 10_000)
    h = S.head(spark, path)
    asked = spark.range(0, 20_000, 40).selectExpr("id + 1 id")  # all in one of the four files
    scanned = []
    monkeypatch.setattr(S, "_scan", lambda s, p, schema, names, real=S._scan: scanned.append(names) or real(s, p, schema, names))
    assert len(S.files_with(spark, path, h, asked)) == 1
    live = S.files(spark, path, h)
    index = S._filters(spark, path, h).join(live, "file")
    F = S.F
    k = asked.select("id", *[b.alias(f"b{i}") for i, b in enumerate(S._bits(F.col("id")))], F.explode(F.lit([r[0] for r in live.select("blocks").distinct().collect()])).alias("blocks"))
    hits = k.withColumn("block", S._block(F.col("id"), F.col("blocks")).cast("int")).join(index, ["blocks", "block"])
    for i in range(S.HASHES):
        hits = hits.where(S._bit_set(F.col("bits"), F.col(f"b{i}")))
    n = hits.count()
    assert 500 <= n <= 500 + 0.01 * 3 * 500 + 3  # every key in its file, at most 1 % of the other probes
    monkeypatch.setattr(S, "PROBES", 0)  # the way without filters gives the same files
    assert S.files_with(spark, path, h, asked) == S.files_with(spark, path, h, asked.where("id >= 0"))


def test_any_batches_equal_a_plain_dict(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MERGE_WRITES", 2)
    path, rng, want = str(tmp_path / "t"), random.Random(4), {}
    for o in range(5):
        batch = [(rng.choice([None, *range(30)]), f"{o}-{i}", o * 100 + i) for i in range(12)]
        want |= {k: v for k, v, _ in batch}
        S.upsert(spark, spark.createDataFrame(batch, ROWS), path, "id", "o", 7)
        assert contents(read_table(spark, path)) == want
    assert read_table(spark, path).count() == len(want)
    assert len(S.head(spark, path)["writes"]) <= 2
    assert S.compact(spark, path, 1000) == 6 and contents(read_table(spark, path)) == want and len(read_table(spark, path).inputFiles()) < 5
    first = len(contents(S.read(spark, path, 1)))
    assert first < len(want)
    assert S.vacuum(spark, path, keep=1, older_than=-5) > 0
    assert contents(read_table(spark, path)) == want
    with pytest.raises(ValueError):
        S.read(spark, path, 1)
    S.upsert(spark, spark.createDataFrame([(5, "z", 1)], ROWS), path, "id", "o")
    assert contents(read_table(spark, path)) == want | {5: "z"}


def test_new_columns_empty_tables_and_plain_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace(spark, spark.createDataFrame([], ROWS), path, "id")
    assert table_exists(spark, path) and read_table(spark, path).count() == 0
    S.upsert(spark, spark.createDataFrame([(1, "a", 0)], ROWS), path, "id", "o")
    S.upsert(spark, spark.createDataFrame([(2, "b", 0, 1.5)], f"{ROWS}, extra double"), path, "id", "o")
    assert sorted((r["id"], r["extra"]) for r in read_table(spark, path).collect()) == [(1, None), (2, 1.5)]
    with pytest.raises(ValueError):
        S.upsert(spark, spark.createDataFrame([(1, "a", 0)], ROWS), path, "v", "o")
    plain = str(tmp_path / "plain")
    spark.range(10).selectExpr("id", "'a' v", "0L o").write.parquet(plain)
    S.upsert(spark, spark.createDataFrame([(3, "b", 1), (10, "c", 1)], ROWS), plain, "id", "o")
    assert contents(read_table(spark, plain)) == dict.fromkeys(range(10), "a") | {3: "b", 10: "c"}
    assert contents(S.read(spark, plain, 1)) == dict.fromkeys(range(10), "a")
    assert register_views(spark, {"t_plain": plain, "t_none": str(tmp_path / "none")}) == ["t_plain"]
    assert spark.table("t_plain").count() == 11
    assert S.update(spark, spark.createDataFrame([(77, "x")], "id long, v string"), plain, "id", ["v"]) == 2  # no such key: no version


def test_written_files_are_opened_once_to_describe_them(spark, tmp_path, monkeypatch):
    read, file = spark.sparkContext.accumulator(0), S._file
    monkeypatch.setattr(S, "_file", lambda: F.udf(lambda f: read.add(1) or f, "string").asNondeterministic()(file()))
    df = spark.range(1000).select(F.when(F.col("id") % 100 > 0, F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    path = str(tmp_path / "t")
    S.replace(spark, df, path, "k", 50)
    assert read.value == 1000
    monkeypatch.undo()
    h = S.head(spark, path)
    got = {r["file"]: (r["rows"], r["nulls"], r["low"], r["high"], r["blocks"]) for r in S.files(spark, path, h).collect()}
    rows = S.read(spark, path).select(S._file().alias("file"), "k").collect()
    assert len(got) >= 20 and len(rows) == 1000
    for name, seen in got.items():
        keys = [r["k"] for r in rows if r["file"] == name]
        known = [k for k in keys if k is not None]
        assert seen == (len(keys), len(keys) - len(known), min(known, default=None), max(known, default=None), 1)
    bits = {r["file"]: bytes(r["bits"]) for r in S._filters(spark, path, h).collect()}
    assert bits.keys() == got.keys()
    asked = spark.createDataFrame([(r["file"], r["k"]) for r in rows], "file string, k string").select("file", F.array(*S._bits(F.col("k"))).alias("at"))
    assert all(bits[r["file"]][i // 8] >> i % 8 & 1 for r in asked.collect() for i in r["at"])
    assert not list((tmp_path / "t" / "_work").glob("*"))
