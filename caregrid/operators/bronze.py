"""Ingest: raw registry -> Bronze (S2, S12, P1, P3, P5-P8, P12, A2) and the quality report (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregrid.functions.core import hash_id, sentinel_null
from caregrid.functions.text import clean_postcode, normalise_facility_type, to_double, to_long
from caregrid.operators.dedup import dedup_keep_first
from caregrid.schemas import DOUBLE_COLUMNS, KEPT_COLUMNS, LONG_COLUMNS

COMPOSITE_FIELDS = ("name", "description", "specialties", "procedure", "equipment", "capability")


def project_kept(raw: DataFrame, kept=KEPT_COLUMNS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Select the kept columns in order; absent ones become typed nulls."""
    cols = []
    for c in kept:
        if c in raw.columns:
            cols.append(F.col(c))
        else:
            cols.append(F.lit(None).cast("string").alias(c))
    return raw.select(*cols, *[F.col(c) for c in carry if c in raw.columns])


def normalise_nas(df: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Sentinel strings -> null on string columns; NaN -> null on doubles."""
    out = []
    for f in df.schema.fields:
        name = f.name
        if only is not None and name not in only:
            out.append(F.col(name))
        elif isinstance(f.dataType, T.StringType):
            out.append(sentinel_null(name).alias(name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(F.isnan(name), F.lit(None).cast(f.dataType)).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def composite_text(*fields: str):
    """Trimmed non-blank fields joined by ' | '."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in fields])


def ingest(raw: DataFrame, order_col: str = "src_ord", carry: tuple[str, ...] = ()) -> DataFrame:
    """Raw registry (string columns) -> Bronze, one row per facility_id (first in source order).

    ``carry`` lists extra source columns (e.g. category) kept beside the Bronze
    columns; they ride along the dedup, so the kept row's attributes equal what a
    left join back to the deduped source would attach (J2) without a second shuffle.
    """
    df = project_kept(raw, carry=(order_col, *carry))
    string_kept = tuple(c for c in KEPT_COLUMNS if c not in DOUBLE_COLUMNS + LONG_COLUMNS)
    df = normalise_nas(df.select(
        *[F.col(c).cast("string").alias(c) if c in string_kept else F.col(c) for c in df.columns]
    ), only=string_kept)
    typed = df.select(
        *[
            (clean_postcode(c).alias(c) if c == "address_zipOrPostcode"
             else normalise_facility_type(c).alias(c) if c == "facilityTypeId"
             else to_double(c).alias(c) if c in DOUBLE_COLUMNS
             else to_long(c).alias(c) if c in LONG_COLUMNS
             else F.col(c))
            for c in df.columns
        ]
    )
    text = composite_text(*COMPOSITE_FIELDS)
    bronze = typed.select(
        "*",
        hash_id("name", "address_city", "address_zipOrPostcode").alias("facility_id"),
        text.alias("composite_text"),
    ).withColumn("composite_text_length", F.length("composite_text").cast("long"))
    bronze = dedup_keep_first(bronze, ["facility_id"], order_col)
    return bronze.withColumn("_ingest_ts", F.current_timestamp())


def quality_report(bronze: DataFrame) -> DataFrame:
    """A4: one-row ingestion quality report (non-blank counts only)."""
    nonblank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    equip = F.trim(F.coalesce(F.col("equipment"), F.lit("")))
    return bronze.agg(
        F.count(F.lit(1)).cast("long").alias("total_rows"),
        F.count_if(nonblank("description")).cast("long").alias("with_description"),
        F.count_if((F.length(equip) > 0) & (equip != "[]")).cast("long").alias("with_equipment"),
        F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).cast("long").alias("with_lat_lon"),
        F.count_if(nonblank("address_zipOrPostcode")).cast("long").alias("with_pin_code"),
        F.count_distinct("facility_id").cast("long").alias("distinct_facility_ids"),
    )
