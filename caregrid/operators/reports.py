"""Summaries and report projections (A6, A9-A11, A16, W5, W6, D19, F11) and the
derived correction batch / rule-Gold helpers used by the merge and D4 queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caregrid.functions.core import rnd, trust_grade
from caregrid.operators import trust as TR


def smoke_summary(gold: DataFrame) -> DataFrame:
    """Rows, avg trust (3), avg confidence.overall (3), rows below 0.65 trust."""
    return gold.agg(
        F.count(F.lit(1)).cast("long").alias("rows"),
        rnd(F.avg("trust_score"), 3).alias("avg_trust"),
        rnd(F.avg("confidence.overall"), 3).alias("avg_conf"),
        F.count_if(F.col("trust_score") < 0.65).cast("long").alias("low_trust"),
    )


def top_by_trust(gold: DataFrame, n: int) -> DataFrame:
    """The n most trusted facilities (ties by id) -> TakeOrderedAndProject, no full sort."""
    return gold.orderBy(F.desc("trust_score"), F.asc("facility_id")).limit(n).select(
        "facility_id", "name", "address_city", "facility_type",
        F.col("extraction.staff.total_doctor_count").alias("doctors"), "trust_score",
        F.col("confidence.overall").alias("confidence_overall"))


def worst_areas(deserts: DataFrame, n: int) -> DataFrame:
    """The n most underserved areas."""
    top = deserts.orderBy(F.desc("desert_risk_score"), F.asc_nulls_first("pin_code"),
                          F.asc_nulls_first("state")).limit(n)
    return top.select("pin_code", "state", "facility_count", *[rnd(c, 6).alias(c) for c in (
        "avg_trust_score", "icu_coverage", "emergency_coverage", "dialysis_coverage", "surgery_coverage")],
        "desert_risk_score", "is_high_risk", F.array_join("desert_categories", ",").alias("desert_categories"))


def state_distribution(bronze: DataFrame, n: int) -> DataFrame:
    """Facilities per state, top n."""
    return (bronze.groupBy(F.col("address_stateOrRegion").alias("state"))
            .agg(F.count(F.lit(1)).cast("long").alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_first("state")).limit(n))


def registry_profile(reg: DataFrame) -> DataFrame:
    """A10: value counts of type, status and category in long form, plus distinct states and
    rows with coordinates - one pass: counts per (dimension, value) via explode of three pairs."""
    pairs = F.explode(F.array(
        F.struct(F.lit("facility_type").alias("dimension"), F.col("facilityTypeId").alias("value")),
        F.struct(F.lit("functional_status").alias("dimension"), F.col("functional_status").alias("value")),
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value")),
    )).alias("p")
    counts = reg.select(pairs).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).cast("long").alias("n"))
    extra = reg.agg(
        F.count_distinct("address_stateOrRegion").cast("long").alias("distinct_states"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).cast("long").alias("with_coordinates"),
    ).selectExpr("stack(2, 'distinct_states', CAST(NULL AS STRING), distinct_states, "
                 "'with_coordinates', CAST(NULL AS STRING), with_coordinates) AS (dimension, value, n)")
    return counts.unionByName(extra)


def quality_gates(bronze: DataFrame, gold: DataFrame, vectors: DataFrame, silver: DataFrame,
                  failures: DataFrame) -> DataFrame:
    """Description share > 60%, extraction success (Silver rows of all extracted) > 85%, indexed rows = Gold rows."""
    rows = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    b = bronze.agg(F.count(F.lit(1)).alias("n"),
                   F.count_if(F.length(F.trim(F.coalesce("description", F.lit("")))) > 0).alias("d"))
    row = side_by_side(b, rows(gold, "g"), rows(vectors, "v"), rows(silver, "s"), rows(failures, "f"))
    share = lambda a, b: F.when(b > 0, rnd(a / b, 6))
    gates = row.select(F.explode(F.array(
        F.struct(F.lit("description_share").alias("gate"), share(F.col("d"), F.col("n")).alias("value"),
                 F.lit(0.6).alias("threshold")),
        F.struct(F.lit("extraction_success").alias("gate"), share(F.col("s"), F.col("s") + F.col("f")).alias("value"),
                 F.lit(0.85).alias("threshold")),
        F.struct(F.lit("indexed_share").alias("gate"), share(F.col("v"), F.col("g")).alias("value"),
                 F.lit(1.0).alias("threshold")),
    )).alias("x")).select("x.*")
    return gates.withColumn("pass", F.when(F.col("gate") == "indexed_share", F.col("value") == F.col("threshold"))
                            .otherwise(F.col("value") > F.col("threshold")))


def geo_ready_regions(deserts: DataFrame) -> DataFrame:
    """regions with a centroid (the records the JSON sink S9 exports)."""
    return deserts.where(F.col("centroid_lat").isNotNull()).select(
        "pin_code", "state", rnd("centroid_lat", 6).alias("centroid_lat"), rnd("centroid_lon", 6).alias("centroid_lon"),
        "desert_risk_score")


def trust_report(gold: DataFrame) -> DataFrame:
    """Per facility the trust report - grade, flags with their details, confidence, and the six
    sections of the extraction."""
    return gold.select(
        "facility_id", "name",
        F.concat(F.coalesce("address_city", F.lit("None")), F.lit(", "), F.coalesce("address_state", F.lit("None")))
        .alias("location"),
        "trust_score", trust_grade("trust_score").alias("trust_grade"), "trust_flags", "confidence", "correction_iterations",
        F.struct(*[F.col(f"extraction.{s}").alias(s) for s in ("icu", "ventilator", "staff", "emergency", "surgery", "dialysis")])
        .alias("extraction_summary"),
        F.col("extraction.extraction_notes").alias("extraction_notes"),
    )


def facility_profile(gold: DataFrame) -> DataFrame:
    """Per facility the full profile - address, coordinates, trust, confidence and all capabilities."""
    return gold.select(
        "facility_id", "name",
        F.struct(F.col("address_city").alias("city"), F.col("address_state").alias("state"), F.col("address_zip").alias("pin_code")).alias("address"),
        F.struct("latitude", "longitude").alias("coordinates"),
        "facility_type", "operator_type", "trust_score", "trust_flags", "confidence",
        F.col("extraction").alias("capabilities"), "correction_iterations",
    )


def correction_batch(gold: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update batch derived from the data: every low-trust (< 0.65) Gold row re-scored twice
    (the later version must win), plus every supplier as a new facility."""
    from caregrid.sources.testdata import read_table

    low = gold.where(F.col("trust_score") < 0.65).select(
        "facility_id", "name", "trust_score", "src_key",
        F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))
    upd = low.select(
        "facility_id", F.concat("name", F.lit(" v"), F.col("v").cast("string")).alias("name"),
        rnd(F.least(F.lit(1.0), F.col("trust_score") + F.col("v").cast("double") * F.lit(0.1)), 3).alias("trust_score"),
        (F.col("src_key") * 10 + F.col("v")).alias("batch_ord"))
    s = read_table(spark, sf_dir, "supplier")
    new = s.select(F.sha2(F.concat(F.lit("supplier|"), F.col("s_suppkey").cast("string")), 256).alias("facility_id"),
                   F.col("s_name").alias("name"), F.lit(0.5).alias("trust_score"),
                   (F.col("s_suppkey") * 10 + 3).alias("batch_ord"))
    return upd.unionByName(new)


def rule_gold_from_heuristic_silver(bronze: DataFrame, silver_path: str | None = None) -> DataFrame:
    """J1 + X2 + D4: the heuristic Silver written as JSON text (as a model would return it),
    parsed back and validated into the Silver table, then rule Gold from Silver inner-join Bronze.

    With ``silver_path`` the validated Silver is written there first (the medallion
    boundary), so the rule plan starts from a scan of typed records.
    """
    from caregrid.functions.parse import parse_replies
    from caregrid.operators.gold import rule_gold
    from caregrid.operators.infer import infer_extraction

    silver = bronze.select("facility_id", F.to_json(infer_extraction("category", "functional_status"))
                           .alias("extraction_json"))
    parsed = parse_replies(silver, "extraction_json", "facility_id").select("facility_id", "extraction")
    if silver_path is not None:
        parsed.write.mode("overwrite").parquet(silver_path)
        parsed = bronze.sparkSession.read.parquet(silver_path)
    return rule_gold(parsed, bronze)


def yield_rollup(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Silver rows, gold rows, avg trust (3), avg confidence (3), token sums - two one-row
    aggregates side by side."""
    s = silver.agg(F.count(F.lit(1)).cast("long").alias("silver_rows"),
                   F.sum("prompt_tokens").cast("long").alias("total_prompt_tokens"),
                   F.sum("completion_tokens").cast("long").alias("total_completion_tokens"))
    g = gold.agg(F.count(F.lit(1)).cast("long").alias("gold_rows"), rnd(F.avg("trust_score"), 3).alias("avg_trust"),
                 rnd(F.avg("confidence.overall"), 3).alias("avg_conf"))
    return side_by_side(s, g)


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Single-row aggregates next to each other: a union with nulls, reduced to one row."""
    names = [c for df in one_row for c in df.columns]
    out = one_row[0]
    for df in one_row[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in names])


def readiness(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """One row per layer - exists flag and row count (0 when the table is missing)."""
    from caregrid.sources.files import read_table, table_exists

    rows = []
    for name, path in tables.items():
        if table_exists(spark, path):
            rows.append(read_table(spark, path).agg(F.count(F.lit(1)).cast("long").alias("rows"))
                        .select(F.lit(name).alias("layer"), F.lit(True).alias("ready"), "rows"))
        else:
            rows.append(spark.range(1).select(F.lit(name).alias("layer"), F.lit(False).alias("ready"),
                                              F.lit(0).cast("long").alias("rows")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def trace_metrics(gold: DataFrame, silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """Per facility - text length, trust, tokens, latency, flag count, high-severity flags, iterations."""
    return (gold.join(silver, "facility_id", "inner").join(bronze.select("facility_id", "composite_text_length"),
                                                            "facility_id", "inner")
            .select("facility_id", "composite_text_length", "trust_score",
                    (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), "latency_ms",
                    F.size("trust_flags").alias("n_flags"), TR.n_high_flags("trust_flags").alias("n_high_flags"),
                    "correction_iterations"))
