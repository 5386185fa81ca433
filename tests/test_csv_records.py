"""The splittable CSV reader against Spark's multiLine reader, for files cut at every byte."""

import csv
import random

import pytest

from caregrid.sources.csv_records import ends_inside, read_csv_records

COLUMNS = ["id", "name", "note"]
BASE = 'id,name,"no\nte"\n1,"a\nb","x ""y""\n\n,z"\n2,5" pipe,\n\n3,"é\r\nü",q"q\n4,"""\n""","\n\n\n"\n5,"",end'


@pytest.fixture
def split_at(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def whole(spark, path):
    df = spark.read.schema("id string, name string, note string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("size", [1, 2, 7, 16, 1000])
def test_equals_multi_line_cut_anywhere(spark, split_at, tmp_path, size):
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_bytes(BASE.encode())
    want = whole(spark, path)
    assert len(want) == 5
    split_at(size)
    rows, rejects = read_csv_records(spark, path, COLUMNS)
    got = rows.collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == want
    assert [r["id"] for r in sorted(got, key=lambda r: r["src_ord"])] == ["1", "2", "3", "4", "5"]
    assert rejects.count() == 0
    if size == 7:
        assert rows.rdd.getNumPartitions() > 1


def test_carriage_returns_end_records_but_stay_in_quotes(spark, split_at, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,name,note\r\n1,"a\r\nb",c\r\n\r\n2,"x\ny",z\r\n')
    split_at(3)
    rows, rejects = read_csv_records(spark, str(tmp_path / "a.csv"), COLUMNS)
    assert sorted(tuple(r)[:3] for r in rows.collect()) == [("1", "a\r\nb", "c"), ("2", "x\ny", "z")]
    assert rejects.count() == 0


def test_random_files_split_into_tasks(spark, split_at, tmp_path):
    rng = random.Random(3)
    for k in range(3):
        with open(tmp_path / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(COLUMNS)
            for i in range(400):
                out.writerow([f"{k}-{i}", *("".join(rng.choice('ab,"\n ') for _ in range(rng.choice([1, 5, 400]))) + "." for _ in range(2))])
    path = str(tmp_path)
    want = whole(spark, path)
    split_at(5000)
    rows, rejects = read_csv_records(spark, path, COLUMNS)
    assert sorted((tuple(r)[:3] for r in rows.collect()), key=str) == want and len(want) == 1200
    assert rejects.count() == 0


def test_rejects_are_whole(spark, split_at, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,note\n1,a\n2,b,c\n3,d,e,"f\ng"\n4,"open\n5,x,y\n')
    split_at(4)
    rows, rejects = read_csv_records(spark, str(tmp_path / "a.csv"), COLUMNS)
    assert [tuple(r)[:3] for r in rows.collect()] == [("2", "b", "c")]
    assert sorted((r["record"], r["reason"]) for r in rejects.collect()) == [
        ("1,a", "number of fields"), ('3,d,e,"f\ng"', "number of fields"), ('4,"open\n5,x,y', "quote not closed")]


def test_empty_file_and_changed_blocks(spark, split_at, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,note\n")
    rows, rejects = read_csv_records(spark, str(tmp_path / "a.csv"), COLUMNS)
    assert rows.count() == rejects.count() == 0
    (tmp_path / "b.csv").write_text("id,name,note\n" + '1,"a\nb",c\n' * 40)
    rows, _ = read_csv_records(spark, str(tmp_path / "b.csv"), COLUMNS)
    split_at(50)
    with pytest.raises(Exception, match="not seen by the first pass"):
        rows.collect()
    with pytest.raises(ValueError):
        read_csv_records(spark, str(tmp_path / "b.csv"), ["a", "A"])


def test_states_of_a_line():
    assert [ends_inside(x, False) for x in ('', 'a"b', '"a', '"a""', 'x,"a', '"a"b","', ',,"')] == [False, False, True, True, True, True, True]
    assert [ends_inside(x, True) for x in ('', '"', '""', 'a"b,"', 'a",b"')] == [True, False, True, True, False]
