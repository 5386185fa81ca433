"""Gold assembly: rule Gold from Silver (D4) and heuristic Gold (D5), with the
embedding text (X13). One select chain each; no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregrid.functions.core import clean_str, col
from caregrid.functions.text import normalise_facility_type
from caregrid.operators.infer import infer_extraction
from caregrid.operators.trust import (
    confidence, heuristic_adjust, trust_flags, trust_score_from_flags,
)

GOLD_COLUMNS = (
    "facility_id", "name", "address_city", "address_state", "address_zip", "latitude", "longitude",
    "facility_type", "operator_type", "extraction", "trust_score", "trust_flags", "confidence",
    "correction_iterations", "embedding_text", "extraction_version",
)
HEURISTIC_EXTRA = ("category", "functional_status", "accessibility_note")


def embedding_text(name, city, state, pin, facility_type, ex, trust_score) -> Column:
    """One sentence per facility, raw text <= 300 chars, total <= 2000."""
    ex = col(ex)
    specs = F.slice(F.coalesce(ex["specialties_extracted"], F.array().cast("array<string>")), 1, 20)
    specs_txt = F.when(F.size(specs) > 0, F.array_join(specs, ", ")).otherwise(F.lit("none extracted"))
    raw_used = F.substring(F.coalesce(ex["raw_text_used"], F.lit("")), 1, 300)
    parts = F.concat_ws(
        " ",
        F.concat(F.lit("Facility: "), F.coalesce(col(name), F.lit("")), F.lit(".")),
        F.concat(F.lit("Location: "), F.coalesce(clean_str(city), F.lit("Unknown city")), F.lit(", "),
                 F.coalesce(clean_str(state), F.lit("Unknown state")), F.lit(", PIN "),
                 F.coalesce(clean_str(pin), F.lit("unknown")), F.lit(".")),
        F.concat(F.lit("Type: "), col(facility_type), F.lit(".")),
        F.concat(F.lit("Specialties: "), specs_txt, F.lit(".")),
        F.concat(F.lit("ICU: "), F.coalesce(ex["icu"]["present"], F.lit("uncertain")),
                 F.lit(". Emergency: "), F.coalesce(ex["emergency"]["emergency_care"], F.lit("uncertain")),
                 F.lit(". Surgery: "), F.coalesce(ex["surgery"]["general_surgery"], F.lit("uncertain")), F.lit(".")),
        F.concat(F.lit("Trust score: "), col(trust_score).cast("string"), F.lit(".")),
        F.nullif(raw_used, F.lit("")),
    )
    return F.substring(parts, 1, 2000)


def heuristic_gold(bronze: DataFrame) -> DataFrame:
    """Bronze (+ carried category, functional_status, accessibility_note) -> heuristic Gold.

    Trust rules run with number_doctors = null and the Bronze text length (0 when
    the facility is not functional); then the category boost and the functional
    penalty; confidence uses the same flags and length.
    """
    func = F.coalesce(F.col("functional_status"), F.lit(""))
    ctl = F.when(F.lower(func) == "not functional", F.lit(0)).otherwise(
        F.coalesce(F.col("composite_text_length"), F.lit(60)))
    staged = bronze.select(
        "*",
        infer_extraction("category", "functional_status").alias("extraction"),
        normalise_facility_type("facilityTypeId").alias("facility_type"),
        ctl.cast("long").alias("_ctl"),
    )
    staged = staged.withColumn("trust_flags", trust_flags("extraction", "facility_type", None, "_ctl"))
    staged = staged.withColumn(
        "trust_score",
        heuristic_adjust(trust_score_from_flags("trust_flags"), "category", "functional_status"))
    return staged.select(
        "facility_id",
        F.coalesce(clean_str("name"), F.lit("")).alias("name"),
        clean_str("address_city").alias("address_city"),
        clean_str("address_stateOrRegion").alias("address_state"),
        clean_str("address_zipOrPostcode").alias("address_zip"),
        "latitude", "longitude", "facility_type",
        clean_str("operatorTypeId").alias("operator_type"),
        clean_str("category").alias("category"),
        clean_str("functional_status").alias("functional_status"),
        clean_str("accessibility_note").alias("accessibility_note"),
        "extraction", "trust_score", "trust_flags",
        confidence("extraction", "trust_flags", "_ctl").alias("confidence"),
        F.lit(0).alias("correction_iterations"),
        embedding_text("name", "address_city", "address_stateOrRegion", "address_zipOrPostcode",
                       "facility_type", "extraction", "trust_score").alias("embedding_text"),
        F.lit("heuristic-1.0").alias("extraction_version"),
        *[c for c in bronze.columns if c in ("src_key",)],
    )


def rule_gold(silver: DataFrame, bronze: DataFrame, extraction_col: str = "extraction") -> DataFrame:
    """Silver (typed extraction) inner-join Bronze on facility_id (J1) -> rules -> confidence -> text.

    Rows whose extraction is null (bad JSON upstream) are skipped, as the reference does.
    """
    b = bronze.select(
        "facility_id", "name", "address_city", "address_stateOrRegion", "address_zipOrPostcode",
        "latitude", "longitude", "facilityTypeId", "operatorTypeId", "numberDoctors", "composite_text_length",
        *[c for c in bronze.columns if c in ("src_key",)],
    )
    s = silver.select("facility_id", F.col(extraction_col).alias("extraction")).where(F.col("extraction").isNotNull())
    j = s.join(b, "facility_id", "inner")
    ctl = F.coalesce(F.col("composite_text_length"), F.lit(0)).cast("long")
    staged = j.select(
        "*", normalise_facility_type("facilityTypeId").alias("facility_type"), ctl.alias("_ctl"))
    staged = staged.withColumn(
        "trust_flags", trust_flags("extraction", "facility_type", "numberDoctors", "_ctl"))
    staged = staged.withColumn("trust_score", trust_score_from_flags("trust_flags"))
    return staged.select(
        "facility_id",
        F.coalesce(clean_str("name"), F.lit("")).alias("name"),
        clean_str("address_city").alias("address_city"),
        clean_str("address_stateOrRegion").alias("address_state"),
        clean_str("address_zipOrPostcode").alias("address_zip"),
        "latitude", "longitude", "facility_type",
        clean_str("operatorTypeId").alias("operator_type"),
        "extraction", "trust_score", "trust_flags",
        confidence("extraction", "trust_flags", "_ctl").alias("confidence"),
        F.lit(0).alias("correction_iterations"),
        embedding_text("name", "address_city", "address_stateOrRegion", "address_zipOrPostcode",
                       "facility_type", "extraction", "trust_score").alias("embedding_text"),
        F.lit("1.0").alias("extraction_version"),
        *[c for c in b.columns if c in ("src_key",)],
    )


def gold_summary(gold: DataFrame) -> DataFrame:
    """A5: rows, average trust, share with trust >= 0.7."""
    return gold.agg(
        F.count(F.lit(1)).cast("long").alias("gold_rows"),
        F.avg("trust_score").alias("avg_trust_score"),
        F.avg((F.col("trust_score") >= 0.7).cast("double")).alias("pct_trust_above_0_7"),
    )
