"""National registry loader: split union (S6), column mapping (S7), derived
text (P2, P4, P9-P11, P13), the keep-row filter (F1) and source-id dedup (A2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregrid.functions.core import blank_to_empty
from caregrid.functions.text import (
    category_capabilities, labelled_composite_text, national_description, normalise_national_type,
)
from caregrid.operators.dedup import dedup_keep_first


def union_splits(splits: list[DataFrame | None]) -> DataFrame:
    """Union of the present splits by column name; absent splits are skipped."""
    present = [s for s in splits if s is not None]
    if not present:
        raise FileNotFoundError("no split of the source could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def pick_column(df: DataFrame, *candidates: str, cast: str = "string"):
    """Column-level fallback - the first candidate column present in the frame
    (a missing column is not the same as a null value), else a typed null."""
    for c in candidates:
        if c in df.columns:
            return F.col(c).cast(cast)
    return F.lit(None).cast(cast)


def load_national(raw: DataFrame, order_col: str = "src_ord", keep: tuple[str, ...] = ("src_key",)) -> DataFrame:
    """Map a raw national frame to registry columns (all text as trimmed strings)."""
    name = blank_to_empty(pick_column(raw, "prmry_name", "alt_name"))
    mapped = raw.select(
        *[F.col(c) for c in (order_col, *keep) if c in raw.columns],
        name.alias("name"),
        pick_column(raw, "latitude", "y").try_cast("double").alias("latitude"),
        pick_column(raw, "longitude", "x").try_cast("double").alias("longitude"),
        blank_to_empty(pick_column(raw, "statename")).alias("address_stateOrRegion"),
        blank_to_empty(pick_column(raw, "lganame")).alias("address_city"),
        blank_to_empty(pick_column(raw, "wardname")).alias("address_zipOrPostcode"),
        normalise_national_type(pick_column(raw, "type")).alias("facilityTypeId"),
        blank_to_empty(pick_column(raw, "category")).alias("category"),
        blank_to_empty(pick_column(raw, "func_stats")).alias("functional_status"),
        blank_to_empty(pick_column(raw, "ownership")).alias("operatorTypeId"),
        blank_to_empty(pick_column(raw, "accessblty")).alias("accessibility_note"),
        F.coalesce(pick_column(raw, "source"), F.lit("HDX/NHFR")).alias("data_source"),
        F.coalesce(pick_column(raw, "globalid"), F.lit("")).alias("globalid"),
    )
    caps = category_capabilities("category")
    out = mapped.select(
        "*",
        F.lit(None).cast("string").alias("numberDoctors"),
        national_description("name", "category", "operatorTypeId", "address_stateOrRegion",
                             "address_city", "functional_status").alias("description"),
        caps.alias("specialties"),
        caps.alias("capability"),
        F.lit("").alias("equipment"),
        F.lit("").alias("procedure"),
    )
    text = labelled_composite_text("name", "category", "facilityTypeId", "functional_status",
                                   "operatorTypeId", "address_city", "address_stateOrRegion",
                                   "accessibility_note")
    # md5(name|lat|lon)[:16]; a missing coordinate prints as Python's 'nan'
    lat_txt = F.coalesce(F.col("latitude").cast("string"), F.lit("nan"))
    lon_txt = F.coalesce(F.col("longitude").cast("string"), F.lit("nan"))
    out = out.select(
        "*",
        text.alias("composite_text"),
        F.length(text).cast("long").alias("composite_text_length"),
        F.substring(F.md5(F.concat_ws("|", F.col("name"), lat_txt, lon_txt)), 1, 16).alias("source_id"),
    )
    # keep a row if it has a name or both coordinates
    out = out.where((F.length("name") > 0) | (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()))
    # A2: dedup on the source id, keep first in source order
    return dedup_keep_first(out, ["source_id"], order_col)
