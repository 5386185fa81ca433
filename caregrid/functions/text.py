"""Text normalisers and derived-text expressions (P*, X9, X10, X17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caregrid.functions.core import col, compact, contains_any, first_match, sentinel_null
from caregrid.schemas import FACILITY_TYPES, PHARMACY_ALIASES

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Ordered substring map for raw national facility types (first hit wins).
NATIONAL_TYPE_MAP = (
    ("hospital", "hospital"),
    ("health centre", "clinic"),
    ("health center", "clinic"),
    ("clinic", "clinic"),
    ("dispensary", "clinic"),
    ("maternity", "clinic"),
    ("pharmacy", "pharmacy"),
    ("laboratory", "clinic"),
    ("dental", "dentist"),
    ("dentist", "dentist"),
    ("doctor", "doctor"),
    ("primary health care", "clinic"),
    ("phc", "clinic"),
)

# P10: category -> capability keywords (ordered branches, joined by ', ').
CATEGORY_CAPABILITIES = (
    (("teaching", "federal medical"), "ICU, emergency care, surgery, dialysis, specialist services, 24/7 emergency"),
    (("specialist",), "specialist care, emergency care, surgery"),
    (("general hospital", "district hospital", "cottage"), "emergency care, general surgery, maternity, inpatient care"),
    (("comprehensive",), "emergency care, maternity, general surgery"),
    (("maternity",), "maternity, antenatal care, postnatal care, normal delivery"),
    (("medical center",), "emergency care, outpatient care"),
    (("primary", "dispensary", "community"), "outpatient care, primary care, immunisation, antenatal"),
)

# Query intent keywords, in tag order (trailing blanks matter).
INTENT_KEYWORDS = (
    ("icu", ("icu", "intensive care", "critical care")),
    ("ventilator", ("ventilator", "vent")),
    ("dialysis", ("dialysis", "kidney", "renal")),
    ("emergency", ("emergency", "casualty", "er ", "24/7", "24x7", "24*7", "trauma")),
    ("trauma", ("trauma", "accident")),
    ("surgery", ("surgery", "surgical", "operation", "ot ", "operation theatre")),
    ("ambulance", ("ambulance", "108", "102")),
    ("maternity", ("maternity", "obstetric", "delivery", "labour", "labor", "caesarean", "c-section")),
    ("pharmacy", ("pharmacy", "chemist", "medicine")),
    ("cardiac", ("cardiac", "cardiology", "heart")),
    ("orthopedic", ("ortho", "bone", "fracture")),
    ("neonatal", ("neonatal", "newborn", "nicu", "baby")),
    ("dentist", ("dentist", "dental", "tooth")),
)

# Free text -> need type, first hit wins.
NEED_FROM_TEXT = (
    (("icu",), "icu"),
    (("maternity", "baby", "birth"), "maternity"),
    (("surgery", "operation"), "surgery"),
    (("dialysis", "kidney"), "dialysis"),
    (("emergency", "help"), "emergency"),
)

# ---------------------------------------------------------------------------


def normalise_facility_type(c: str | Column) -> Column:
    """Exact enum after trim/lower; farmacy/pharma/chemist -> pharmacy; else unknown."""
    v = F.lower(F.trim(col(c)))
    return (
        F.when(v.isin(*PHARMACY_ALIASES), F.lit("pharmacy"))
        .when(v.isin(*FACILITY_TYPES), v)
        .otherwise(F.lit("unknown"))
    )


def normalise_national_type(c: str | Column) -> Column:
    """First substring hit in the ordered national type map; blank -> unknown."""
    v = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return first_match(v, [((k,), val) for k, val in NATIONAL_TYPE_MAP], "unknown")


def category_capabilities(category: str | Column) -> Column:
    """P10: capability keyword text from the category."""
    return first_match(F.lower(F.coalesce(col(category), F.lit(""))), CATEGORY_CAPABILITIES, "")


def clean_postcode(c: str | Column) -> Column:
    """Strip a trailing '.0', trim, sentinels -> null."""
    return sentinel_null(F.trim(F.regexp_replace(col(c).cast("string"), r"\.0$", "")))


def to_double(c: str | Column) -> Column:
    """Numeric coercion, bad -> null (NaN and infinities -> null too)."""
    d = col(c).cast("string").try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None).cast("double")).otherwise(d)


def to_long(c: str | Column) -> Column:
    """P7 for counts: via double, truncated."""
    return to_double(c).try_cast("long")


def national_description(name, category, operator, state, city, func) -> Column:
    """The description sentence built from six loader columns."""
    return F.trim(F.concat(
        F.lit("Facility: "), F.trim(col(name)), F.lit(". Category: "), col(category),
        F.lit(". Ownership: "), col(operator), F.lit(". State: "), col(state),
        F.lit(". LGA: "), col(city), F.lit(". Functional status: "), col(func), F.lit("."),
    ))


def labelled_composite_text(name, category, ftype, func, operator, city, state, access) -> Column:
    """P4: 'Facility name: X. Category: Y. ...' omitting blanks and type 'unknown'."""

    def part(label: str, c, extra=None):
        c = col(c)
        cond = F.coalesce(c, F.lit("")) != ""
        if extra is not None:
            cond = cond & extra
        return F.when(cond, F.concat(F.lit(label), c, F.lit(".")))

    return F.concat_ws(
        " ",
        part("Facility name: ", name),
        part("Category: ", category),
        part("Type: ", ftype, col(ftype) != "unknown"),
        part("Functional status: ", func),
        part("Ownership: ", operator),
        part("LGA: ", city),
        part("State: ", state),
        part("Accessibility: ", access),
    )


def truncate(c: str | Column, n: int) -> Column:
    """First n characters."""
    return F.substring(col(c), 1, n)


def query_intents(text: str | Column) -> Column:
    """Array of intent tags whose keywords occur in lower(text), in tag order."""
    q = F.lower(F.coalesce(col(text), F.lit("")))
    return compact(*[F.when(contains_any(q, kws), F.lit(tag)) for tag, kws in INTENT_KEYWORDS])


def need_from_text(text: str | Column) -> Column:
    """Ordered keyword test on lower(text); no hit -> null."""
    return first_match(F.lower(F.coalesce(col(text), F.lit(""))), NEED_FROM_TEXT, F.lit(None).cast("string"))
