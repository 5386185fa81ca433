"""Joins on bucketed tables: equal results, and no exchange of the tables."""

import re

import pytest
from pyspark.sql import functions as F

from caregrid.operators.rank import enrich, revalidate
from caregrid.operators.reports import trace_metrics
from caregrid.sources.bucketed import buckets_for, open_bucketed, write_bucketed
from caregrid.sources.files import TableMissing

N = 4000


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges_above_scans(df, path):
    """The exchanges of a plan that have a scan of ``path`` below them."""
    text = df._jdf.queryExecution().executedPlan().toString()
    found, open_ = [], []
    for line in text.splitlines():
        depth = len(re.match(r"[\s:+\-|*()0-9]*", line).group())
        open_ = [(d, n) for d, n in open_ if d < depth]
        if "Exchange" in line:
            open_.append((depth, line))
        if "FileScan" in line and path in line:
            found += [n for _, n in open_]
    return found


def gold_rows(spark):
    flag = F.array(F.struct(F.lit("f").alias("flag_type"), F.lit("high").alias("severity"), F.lit("d").alias("description"),
                            F.lit("e").alias("supporting_evidence")))
    nil = F.lit(None).cast("string")
    return spark.range(N).select(
        F.concat(F.lit("f"), F.col("id")).alias("facility_id"), F.concat(F.lit("name "), F.col("id")).alias("name"),
        nil.alias("address_city"), nil.alias("address_state"), nil.alias("address_zip"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"),
        nil.alias("facility_type"), nil.alias("operator_type"), (F.col("id") % 100 / 100).alias("trust_score"), flag.alias("trust_flags"),
        F.struct(F.lit("x").alias("raw_text_used")).alias("extraction"), F.struct(F.lit(0.5).alias("overall")).alias("confidence"),
        F.lit(0).alias("correction_iterations"))


def test_joins_read_without_a_shuffle(spark, tmp_path, no_broadcast):
    gold = gold_rows(spark)
    silver = gold.select("facility_id", F.lit(3).alias("prompt_tokens"), F.lit(4).alias("completion_tokens"), F.lit(1.5).alias("latency_ms"))
    bronze = gold.select("facility_id", F.length("name").alias("composite_text_length"), "name")
    opened = {}
    for name, df in (("gold", gold), ("silver", silver), ("bronze", bronze)):
        write_bucketed(df, f"{tmp_path}/{name}", "facility_id", 7)
        opened[name] = open_bucketed(spark, f"{tmp_path}/{name}")
    plain, by_key = trace_metrics(gold, silver, bronze), trace_metrics(opened["gold"], opened["silver"], opened["bronze"])
    assert "Exchange" not in by_key._jdf.queryExecution().executedPlan().toString()
    assert sorted(plain.collect()) == sorted(by_key.collect()) and by_key.count() == N

    hits = spark.range(600).select(F.concat(F.lit("f"), F.col("id") * 9).alias("facility_id"), (F.col("id") % 5).alias("query_id"))
    queries = spark.range(5).select(F.col("id").alias("query_id"), F.lit(0.4).alias("min_trust_score"))
    flat = str(tmp_path / "flat")
    gold.write.parquet(flat)
    for op in (lambda g: revalidate(hits, queries, g), lambda g: enrich(hits, g)):
        assert sorted(map(str, op(gold).collect())) == sorted(map(str, op(opened["gold"]).collect()))
    assert exchanges_above_scans(enrich(hits, spark.read.parquet(flat)), "flat")  # the test sees a shuffle where there is one
    assert not exchanges_above_scans(enrich(hits, opened["gold"]), "gold")
    # J5 goes on to join the queries by query_id, which moves the joined hits, never Gold alone
    j5 = revalidate(hits, queries.limit(0), opened["gold"])
    assert all("query_id" in x for x in exchanges_above_scans(j5, "gold"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("caregrid_")]


def test_awkward_tables(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (None, "b"), ("", "c"), ("k", None), ("k", "d")], "`a key` string, `b``c` string")
    write_bucketed(df, f"{tmp_path}/t", "a key", 3)
    assert sorted(map(str, open_bucketed(spark, f"{tmp_path}/t").collect())) == sorted(map(str, df.collect()))
    with pytest.raises(FileExistsError):
        write_bucketed(df, f"{tmp_path}/t", "a key", 3)
    write_bucketed(df.where("false"), f"{tmp_path}/none", "a key", 2)
    assert open_bucketed(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        write_bucketed(df, f"{tmp_path}/u", "missing", 3)
    assert [buckets_for(x, 10) for x in (0, 10, 11)] == [1, 1, 2]


def test_a_write_cut_short_is_refused(spark, tmp_path):
    bad = spark.range(4).select(F.col("id").cast("string").alias("k"), F.raise_error(F.lit("cut")).alias("v"))
    with pytest.raises(Exception, match="cut"):
        write_bucketed(bad, f"{tmp_path}/t", "k", 2)
    with pytest.raises(TableMissing):
        open_bucketed(spark, f"{tmp_path}/t")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("caregrid_")]
