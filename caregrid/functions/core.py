"""Scalar column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregrid.schemas import MISSING_SENTINELS

EARTH_RADIUS_KM = 6371.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, scale: int) -> Column:
    """HALF_UP rounding on the decimal text of a double.

    Goes through decimal(18,9) so that every engine rounds the same decimal
    value (Spark's double ``round`` and DuckDB's differ on binary ties).
    """
    return F.round(col(c).cast("decimal(18,9)"), scale).cast("double")


def with_rounded(df: DataFrame, name: str, value: Column, scale: int, exact: Column | None = None) -> DataFrame:
    """Adds ``rnd(exact, scale)`` as ``name``, by decimals only for values next to a tie.

    ``value`` (default: of ``exact``) may differ from it by far less than a thousandth of the last place. The scaled value is
    a column of its own, so that Spark computes it once.
    """
    unit, scaled = float(10 ** scale), f"_{name}_scaled"
    place = F.col(scaled) - F.floor(scaled)
    out = df.withColumn(scaled, value * F.lit(unit) + F.lit(0.5))
    return out.withColumn(name, F.when((place > 1e-3) & (place < 1 - 1e-3), F.floor(scaled) / F.lit(unit))
                          .otherwise(rnd(value if exact is None else exact, scale))).drop(scaled)


def clean_str(c: str | Column) -> Column:
    """null/blank -> null, else trimmed."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def sentinel_null(c: str | Column) -> Column:
    """The missing-value sentinels (nan, <NA>, None, blank) -> null, others untouched."""
    c = col(c)
    return F.when(F.lower(F.trim(c)).isin(*MISSING_SENTINELS), F.lit(None).cast("string")).otherwise(c)


def blank_to_empty(c: str | Column) -> Column:
    """Trim and fill with ''."""
    return F.trim(F.coalesce(col(c), F.lit("")))


def hash_id(*parts: str | Column) -> Column:
    """sha256 hex of lower(trim(part)) joined by '|', null -> ''."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.lower(F.trim(col(p))), F.lit("")) for p in parts]), 256)


def is_present(c: str | Column) -> Column:
    from caregrid.schemas import PRESENT

    return F.coalesce(col(c).isin(*PRESENT), F.lit(False))


def in_set(c: str | Column, values) -> Column:
    return F.coalesce(col(c).isin(*values), F.lit(False))


def py_bool_text(c: str | Column) -> Column:
    """Python's str(bool)."""
    return F.when(col(c), F.lit("True")).otherwise(F.lit("False"))


def py_int_text(c: str | Column) -> Column:
    """Python's str(int | None)."""
    return F.coalesce(col(c).cast("string"), F.lit("None"))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance (km), R = 6371; ``least(1, a)`` guards asin."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dlmb = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def trust_grade(c: str | Column) -> Column:
    """A >= .85, B >= .70, C >= .55, D >= .40, else F."""
    c = F.coalesce(col(c), F.lit(0.0))
    return (
        F.when(c >= 0.85, "A").when(c >= 0.70, "B").when(c >= 0.55, "C").when(c >= 0.40, "D").otherwise("F")
    )


def confidence_band(c: str | Column) -> Column:
    """>= .80 high, >= .60 moderate, >= .40 low, else very low."""
    c = col(c)
    return (
        F.when(c >= 0.80, "high").when(c >= 0.60, "moderate").when(c >= 0.40, "low").otherwise("very low")
    )


def contains_any(text: Column, keywords) -> Column:
    cond = None
    for kw in keywords:
        term = text.contains(kw)
        cond = term if cond is None else (cond | term)
    return cond if cond is not None else F.lit(False)


def first_match(text: Column, table, default) -> Column:
    """Ordered substring table -> value of the first entry whose keywords occur in ``text``."""
    expr = None
    for keywords, value in table:
        value_col = value if isinstance(value, Column) else F.lit(value)
        cond = contains_any(text, keywords)
        expr = F.when(cond, value_col) if expr is None else expr.when(cond, value_col)
    default_col = default if isinstance(default, Column) else F.lit(default)
    return default_col if expr is None else expr.otherwise(default_col)


def compact(*items: Column) -> Column:
    """array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())
