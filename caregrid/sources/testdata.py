"""Adapter: derive registry-shaped inputs from the driver's TPC-H-ish tables.

The driver's tables hold no facilities, so the raw national registry, the
nearest-facility requests, the vector queries and the model replies are
derived by arithmetic that Spark and the DuckDB oracle compute alike. Every
derived table is a projection/join of a whole input table, so its size grows
with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The category cycle used for derived registry rows (12-way on key % 12).
CATEGORY_CYCLE = (
    "Teaching Hospital", "Federal Medical Centre", "Specialist Hospital", "General Hospital",
    "District Hospital", "Cottage Hospital", "Comprehensive Health Centre", "Medical Center",
    "Maternity Home", "Primary Health Centre", "Dispensary", "",
)
# Raw facility-type strings by market segment.
SEGMENT_TYPES = (
    ("HOUSEHOLD", "Hospital"),
    ("MACHINERY", "Primary Health Care Centre"),
    ("FURNITURE", "Dental Clinic"),
    ("BUILDING", "Pharmacy Store"),
    ("AUTOMOBILE", "Laboratory"),
)
# Need type cycle for derived requests (key % 7).
NEED_CYCLE = ("emergency", "icu", "maternity", "surgery", "dialysis", "pediatric", "general")
# Query sentences for derived text queries (label % 8).
QUERY_SENTENCES = (
    "Need an ICU bed with ventilator support",
    "emergency c-section for my wife",
    "kidney dialysis centre near me",
    "24/7 casualty for a road accident",
    "child fever, looking for a paediatric doctor",
    "dental clinic for tooth pain",
    "heart surgery hospital",
    "general checkup",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table spread over the cores when it is a single small file (see ``session.spread``)."""
    from caregrid.session import spread

    return spread(read_table(spark, sf_dir, name))


def _case(c: Column, pairs, default=None) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def coord(key: Column, mult: int, mod: int, base: float) -> Column:
    """base + ((key * mult) % mod) / 1000."""
    return F.lit(base) + ((key * F.lit(mult)) % F.lit(mod)).cast("double") / F.lit(1000.0)


def national_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw national registry rows (column names of the national source).

    ``src_ord`` is the source row order (2k for a customer, 2k+1 for its copy):
    every 41st customer appears twice, the copy half a degree further north,
    which exercises the keep-first dedup at ingest.
    """
    c = read_spread(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    base = (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_name", "r_name")
    )
    k = F.col("c_custkey")
    # every 41st customer appears twice (copy = 1); one scan, no self-union
    base = base.select("*", F.explode(
        F.when(k % 41 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    ward = F.concat(F.lit("Ward-"), (k % 40).cast("string"))
    lat = coord(k, 7919, 10000, 4.0) + F.col("copy").cast("double") * F.lit(0.5)
    return base.select(
        k.alias("src_key"),
        (k * 2 + F.col("copy")).alias("src_ord"),
        F.when(k % 97 == 0, F.lit(None).cast("string")).when(k % 89 == 0, F.lit("  "))
        .otherwise(F.col("c_name")).alias("prmry_name"),
        F.concat(F.lit("Alt "), F.col("c_name")).alias("alt_name"),
        F.when(k % 29 == 0, F.lit(None).cast("double")).otherwise(lat).alias("latitude"),
        F.when(k % 29 == 0, F.lit(None).cast("double")).otherwise(coord(k, 10473, 11000, 3.0)).alias("longitude"),
        F.col("r_name").alias("statename"),
        F.col("n_name").alias("lganame"),
        F.when(k % 31 == 0, F.lit(None).cast("string"))
        .when(k % 53 == 0, F.lit("nan"))
        .when(k % 17 == 0, F.concat(ward, F.lit(".0")))
        .otherwise(ward).alias("wardname"),
        F.when(k % 23 == 0, F.lit(None).cast("string"))
        .otherwise(_case(F.col("c_mktsegment"), SEGMENT_TYPES, "Clinic")).alias("type"),
        _case(k % 12, list(enumerate(CATEGORY_CYCLE)), "").alias("category"),
        F.when(k % 7 == 4, F.lit("Not Functional")).when(k % 7 == 5, F.lit("Partially Functional"))
        .when(k % 7 == 6, F.lit(None).cast("string")).otherwise(F.lit("Functional")).alias("func_stats"),
        F.when(F.col("c_acctbal") < 0, F.lit("Private")).otherwise(F.lit("Public")).alias("ownership"),
        F.when(k % 3 == 0, F.lit("Accessible all year")).when(k % 3 == 1, F.lit("Seasonal access"))
        .otherwise(F.lit(None).cast("string")).alias("accessblty"),
        F.lit("NHFR").alias("source"),
        F.concat(F.lit("{"), k.cast("string"), F.lit("}")).alias("globalid"),
    )


def nearest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nearest-facility request per event."""
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("request_id"),
        coord(k, 7907, 10000, 4.0).alias("lat"),
        coord(k, 10459, 11000, 3.0).alias("lon"),
        _case(k % 7, list(enumerate(NEED_CYCLE)), "general").alias("need_type"),
        F.lit(5).alias("top_k"),
        (F.lit(10.0) + (k % 3).cast("double") * F.lit(20.0)).alias("radius_km"),
        F.when(k % 5 == 0, F.lit(0.5)).otherwise(F.lit(0.0)).alias("min_trust_score"),
        (k % 4 == 0).alias("functional_only"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text query per embedding row: its vector, a sentence by label, and filters."""
    v = read_table(spark, sf_dir, "embeddings")
    lbl = F.col("label")
    states = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return v.select(
        F.col("vec_id").alias("query_id"),
        _case(lbl % 8, list(enumerate(QUERY_SENTENCES)), "general checkup").alias("query"),
        F.col("embedding").alias("query_vec"),
        F.when(lbl < 2, _case(F.col("vec_id") % 5, list(enumerate(states)), None))
        .otherwise(F.lit(None).cast("string")).alias("state"),
        F.lit(None).cast("string").alias("city"),
        F.when(lbl == 9, F.lit("hospital")).otherwise(F.lit(None).cast("string")).alias("facility_type"),
        F.when(lbl == 3, F.lit(0.0)).otherwise(F.lit(None).cast("double")).alias("min_trust_score"),
        F.lit(5).alias("top_k"),
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies (one per event) in the shapes X1/X2 must handle:
    plain JSON, fenced JSON, bad enum, string ints, broken JSON, JSON list strings,
    text before a fence, and a non-object JSON value; chosen by event_id % 8."""
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    n = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"icu":{"present":"claimed","bed_count":'), n,
        F.lit('},"staff":{"specialist_types":["Surgery","Paediatrics"],"total_doctor_count":"'), n,
        F.lit('"},"facility_id":"other"}'),
    )
    reply = (
        F.when(k % 8 == 0, body)
        .when(k % 8 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k % 8 == 2, F.concat(F.lit('{"icu":{"present":"definitely_yes"},"note":"'), F.col("event_type"), F.lit('"}')))
        .when(k % 8 == 3, F.concat(F.lit('{"dialysis":{"present":"confirmed","machine_count":"'), n,
                                   F.lit('.7"},"emergency":{"is_24_7":true,"emergency_care":"claimed"}}')))
        .when(k % 8 == 4, F.concat(F.lit('{"icu": {"present": "claimed"'), n))
        .when(k % 8 == 5, F.concat(F.lit('{"staff":{"specialist_types":"cardiology, oncology, , urology"},'
                                         '"specialties_extracted":"[\\"x\\", \\" y \\"]","ventilator":{"count":"nan"}}')))
        .when(k % 8 == 6, F.concat(F.lit("Here you go:\n```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("["), n, F.lit("]")))
    )
    return e.select(
        F.sha2(F.concat(F.lit("fac-"), k.cast("string")), 256).alias("facility_id"),
        k.alias("event_id"),
        reply.alias("raw_response"),
        F.col("value").alias("latency_ms"),
    )


def national_raw_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second split of the national source (S6): suppliers as facilities with the *alternate*
    column names (alt_name, y, x) and no type/category columns at all (S7 picks by presence)."""
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    base = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("s_suppkey")
    return base.select(
        k.alias("src_key"), (F.lit(10 ** 12) + k).alias("src_ord"), F.col("s_name").alias("alt_name"),
        coord(k, 7561, 9000, 5.0).alias("y"), coord(k, 6007, 9000, 4.0).alias("x"),
        F.col("r_name").alias("statename"), F.col("n_name").alias("lganame"),
    )


def national_raw_orders(spark: SparkSession, sf_dir: str, every: int = 5) -> DataFrame:
    """A larger split for the benchmark: one facility per ``every``-th order, with the national columns."""
    o = read_spread(spark, sf_dir, "orders").where(F.col("o_orderkey") % every == 0)
    k = F.col("o_orderkey")
    return o.select(
        k.alias("src_key"), (F.lit(10 ** 13) + k).alias("src_ord"), F.concat(F.lit("Order "), k.cast("string")).alias("prmry_name"),
        coord(k, 7919, 10000, 4.0).alias("latitude"), coord(k, 10473, 11000, 3.0).alias("longitude"),
        F.concat(F.lit("State "), (k % 37).cast("string")).alias("statename"), F.concat(F.lit("LGA "), (k % 700).cast("string")).alias("lganame"),
        F.concat(F.lit("Ward-"), (k % 40).cast("string")).alias("wardname"), _case(k % 12, list(enumerate(CATEGORY_CYCLE)), "").alias("category"),
        F.lit("Functional").alias("func_stats"))
