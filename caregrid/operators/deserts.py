"""Coverage aggregates per postal area (A1), desert risk (D16), categories (D17),
the desert map query (D18, F8, W4, A13) and rollups (A7, A8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregrid.config import DEFAULT, Params
from caregrid.functions.core import compact, is_present

# Capability weights of the risk score, in formula order.
RISK_WEIGHTS = (("icu", 0.35), ("emergency", 0.30), ("dialysis", 0.20), ("surgery", 0.15))
DESERT_TAGS = (("icu", "ICU_DESERT"), ("dialysis", "DIALYSIS_DESERT"),
               ("emergency", "EMERGENCY_DESERT"), ("surgery", "SURGERY_DESERT"))


def area_coverage(gold: DataFrame) -> DataFrame:
    """A1: GROUP BY (zip, state) over rows with a non-blank zip.

    A single hash aggregate with map-side partial aggregation: a hot area that
    holds a third of all rows is pre-reduced per map task before the shuffle.
    """
    ex = F.col("extraction")
    share = lambda c: F.avg(is_present(c).cast("int"))
    zoned = gold.where(F.length(F.trim("address_zip")) > 0)
    return zoned.groupBy(F.col("address_zip").alias("pin_code"), F.col("address_state").alias("state")).agg(
        F.count(F.lit(1)).cast("long").alias("facility_count"),
        F.avg("trust_score").alias("avg_trust_score"),
        share(ex["icu"]["present"]).alias("icu_coverage"),
        share(ex["dialysis"]["present"]).alias("dialysis_coverage"),
        share(ex["emergency"]["emergency_care"]).alias("emergency_coverage"),
        share(ex["surgery"]["general_surgery"]).alias("surgery_coverage"),
        F.avg("latitude").alias("centroid_lat"),
        F.avg("longitude").alias("centroid_lon"),
    )


def desert_risk(cov: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """D16 + D17: weighted risk (round 3), high-risk flag, desert category tags."""
    from caregrid.functions.core import rnd

    filled = cov.fillna(0.0, subset=[f"{k}_coverage" for k, _ in RISK_WEIGHTS])
    risk = None
    for k, w in RISK_WEIGHTS:
        term = F.lit(w) * (F.lit(1.0) - F.col(f"{k}_coverage"))
        risk = term if risk is None else risk + term
    tags = compact(*[F.when(F.col(f"{k}_coverage") < params.desert_threshold, F.lit(tag)) for k, tag in DESERT_TAGS])
    return (
        filled.withColumn("desert_risk_score", rnd(risk, 3))
        .withColumn("is_high_risk", F.col("desert_risk_score") >= params.desert_high_risk)
        .withColumn("desert_categories",
                    F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("ADEQUATE_COVERAGE"))))
    )


def deserts(gold: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return desert_risk(area_coverage(gold), params)


def desert_summary(d: DataFrame) -> DataFrame:
    """Areas, high-risk areas, average risk."""
    return d.agg(
        F.count(F.lit(1)).cast("long").alias("desert_pin_codes"),
        F.count_if("is_high_risk").cast("long").alias("high_risk_pin_codes"),
        F.avg("desert_risk_score").alias("avg_desert_risk"),
    )


def state_rollup(d: DataFrame, top_n: int | None = 10) -> DataFrame:
    """Per state - areas, high-risk areas, average risk; top n by average risk."""
    out = d.groupBy("state").agg(
        F.count(F.lit(1)).cast("long").alias("areas"),
        F.count_if("is_high_risk").cast("long").alias("high_risk_areas"),
        F.avg("desert_risk_score").alias("avg_risk"),
    )
    if top_n is not None:
        out = out.orderBy(F.desc("avg_risk"), F.asc_nulls_first("state")).limit(top_n)
    return out


def desert_filter(d: DataFrame, state: str | None = None, high_risk_only: bool = False,
                  desert_type: str | None = None) -> DataFrame:
    """F8: every area of a state (any case), of high risk, of one desert type; each filter optional."""
    if state:
        d = d.where(F.lower(F.col("state")) == state.lower())
    if high_risk_only:
        d = d.where(F.col("is_high_risk"))
    if desert_type:
        d = d.where(F.array_contains("desert_categories", desert_type))
    return d


def desert_map(d: DataFrame, state: str | None = None, high_risk_only: bool = False,
               desert_type: str | None = None, limit: int = 100) -> DataFrame:
    """F8 filters -> W4 order by risk desc, limit (a top-k report) -> nested coverage struct."""
    out = desert_filter(d, state, high_risk_only, desert_type)
    out = out.orderBy(F.desc("desert_risk_score"), F.asc_nulls_first("pin_code"), F.asc_nulls_first("state")).limit(limit)
    return out.select(
        "pin_code", "state", "facility_count", "desert_risk_score", "is_high_risk", "desert_categories",
        "centroid_lat", "centroid_lon",
        F.struct(F.col("icu_coverage").alias("icu"), F.col("dialysis_coverage").alias("dialysis"),
                 F.col("emergency_coverage").alias("emergency"),
                 F.col("surgery_coverage").alias("surgery")).alias("coverage"),
        "avg_trust_score",
    )


def desert_map_summary(regions: DataFrame) -> DataFrame:
    """N, high-risk n and percentage (round 1) over the limited result."""
    from caregrid.functions.core import rnd

    n = F.count(F.lit(1))
    hr = F.count_if("is_high_risk")
    return regions.agg(
        n.cast("long").alias("total_regions"),
        hr.cast("long").alias("high_risk_regions"),
        F.when(n > 0, rnd(hr.cast("double") / n.cast("double") * F.lit(100.0), 1)).otherwise(F.lit(0.0))
        .alias("high_risk_percentage"),
    )
