"""Desert aggregates kept up to date (A1, A7, A8, A16, D16, D17) from the changed rows of a versioned Gold table.

The state is a versioned table with one row per area: counts and sums that add up, as decimals, so that what a change
takes away and what it adds leave the same sums as a rebuild. ``refresh`` reads the files that only one of two Gold
versions holds (rows carried over unchanged cancel out), adds up the differences per area and merges them into the
files of the areas concerned. The Gold version that the state stands for is committed with it, so a refresh that dies
is simply run again, and one that is run twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caregrid.config import DEFAULT, Params
from caregrid.functions.core import is_present
from caregrid.operators.deserts import desert_risk
from caregrid.sources import snapshots

CAPS = {"icu": ("icu", "present"), "dialysis": ("dialysis", "present"), "emergency": ("emergency", "emergency_care"), "surgery": ("surgery", "general_surgery")}
MEANS = {"avg_trust_score": "trust_score", "centroid_lat": "latitude", "centroid_lon": "longitude"}
SUM = "decimal(38,12)"
NEEDED = ("address_zip", "address_state", "trust_score", "latitude", "longitude", "extraction")


def _values() -> dict[str, Column]:
    """The values whose means an area shows."""
    ex = F.col("extraction")
    return {f"{k}_coverage": is_present(ex[a][b]).cast("int") for k, (a, b) in CAPS.items()} | {k: F.col(c) for k, c in MEANS.items()}


def partials(gold: DataFrame, sign: int = 1) -> DataFrame:
    """Counts and sums per area of rows with a non-blank zip, times ``sign``; ``area`` is the key."""
    zoned = gold.where(F.length(F.trim("address_zip")) > 0)
    sums = [F.sum(F.lit(sign)).cast("long").alias("facility_count")]
    for name, v in _values().items():
        sums += [F.sum(F.when(v.isNotNull(), sign).otherwise(0)).cast("long").alias(f"n_{name}"),
                 F.coalesce(F.sum(v.cast("decimal(24,12)") * sign).cast(SUM), F.lit(0).cast(SUM)).alias(f"s_{name}")]
    area = F.to_json(F.struct("pin_code", "state"))
    return zoned.groupBy(F.col("address_zip").alias("pin_code"), F.col("address_state").alias("state")).agg(*sums).withColumn("area", area)


def _added(parts: DataFrame) -> DataFrame:
    names = [c for c in parts.columns if c not in ("area", "pin_code", "state")]
    return parts.groupBy("area", "pin_code", "state").agg(*[F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in names])


def coverage(state: DataFrame) -> DataFrame:
    """A1 from the state: the columns of ``deserts.area_coverage``; areas without facilities are gone."""
    mean = lambda name: F.when(F.col(f"n_{name}") > 0, F.col(f"s_{name}").cast("double") / F.col(f"n_{name}")).alias(name)
    order = ["avg_trust_score", *[f"{k}_coverage" for k in CAPS], "centroid_lat", "centroid_lon"]
    return state.where("facility_count > 0").select("pin_code", "state", "facility_count", *[mean(n) for n in order])


def refresh(spark: SparkSession, gold_path: str, state_path: str, rows_per_file: int = snapshots.ROWS_PER_FILE) -> int:
    """Bring the state up to the newest version of the Gold table; returns that version."""
    from caregrid.session import stored

    newest = snapshots.head(spark, gold_path)["version"]
    base = snapshots.head(spark, state_path)
    known = base["meta"]["gold_version"] if base else None
    if known == newest:
        return newest
    before, after = snapshots.changes(spark, gold_path, known, newest)
    delta = _added(partials(after.select(*NEEDED)).unionByName(partials(before.select(*NEEDED), -1)))
    names = [c for c in delta.columns if c not in ("area", "pin_code", "state")]
    delta = stored(delta.where(" OR ".join(f"{c} <> 0" for c in names)), "desert-delta")  # areas that changed
    old = snapshots.rows_with(spark, state_path, delta.select("area")).drop("ord") if base else delta.where("false")
    new = _added(old.unionByName(delta)).withColumn("ord", F.lit(0))
    meta = {"gold_version": newest}
    snapshots.upsert(spark, new, state_path, "area", "ord", rows_per_file, meta)
    return newest


def deserts(spark: SparkSession, state_path: str, params: Params = DEFAULT) -> DataFrame:
    """D16 + D17 over the state, as ``deserts.deserts`` over Gold."""
    return desert_risk(coverage(snapshots.read(spark, state_path)), params)
