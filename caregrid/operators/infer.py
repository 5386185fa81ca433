"""Heuristic capability record from a registry category and functional status.

Seven independent ordered branch tables; within a section the first branch
whose keywords occur in the lower-cased category wins. No UDF: each section is
one ``CASE WHEN`` producing a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregrid.schemas import EXTRACTION

# ---------------------------------------------------------------------------
# Category keyword groups and per-section branch tables
# ---------------------------------------------------------------------------

T_ = ("teaching", "federal medical")
SP = ("specialist",)
G = ("general hospital",)
DH = ("district hospital",)
C = ("cottage",)
CO = ("comprehensive",)
M = ("medical center",)
MAT = ("maternity",)
PRIMARY = ("dispensary", "primary")

FN = "<fn>"   # placeholder: 'functional' when status is functional/blank, else 'unknown'
CAT = "<cat>"  # placeholder: 'Category: {category}'

# icu: present, functional_status, bed_count, neonatal_icu, source_text
ICU_BRANCHES = (
    (T_, ("confirmed", FN, 20, "claimed", CAT)),
    (SP + G + DH, ("claimed", FN, None, "uncertain", CAT)),
    (C + CO + M, ("uncertain", "unknown", None, "uncertain", CAT)),
)
ICU_ELSE = ("not_present", "unknown", None, "not_present", "")

# ventilator: present, count, reliability_note, source_text
VENT_BRANCHES = (
    (T_, ("confirmed", 5, None, "")),
    (SP + G, ("claimed", None, None, "")),
)
VENT_ELSE = ("uncertain", None, None, "")

# staff: anesthesiologist, surgeon, general_physician, specialist_types, total_doctor_count, source_text
STAFF_BRANCHES = (
    (T_, ("full_time", "full_time", "full_time",
          ["Surgery", "Internal Medicine", "Obstetrics", "Paediatrics", "Anaesthesiology"], 50, "")),
    (SP, ("on_call", "full_time", "full_time", ["Surgery", "Internal Medicine"], 15, "")),
    (G + DH + C, ("on_call", "on_call", "full_time", ["General Practice"], 5, "")),
    (CO + M, ("unknown", "unknown", "full_time", [], 2, "")),
    (MAT, ("unknown", "unknown", "on_call", ["Obstetrics", "Midwifery"], 2, "")),
)
STAFF_ELSE = ("unknown", "unknown", "unknown", [], None, "")

# emergency: emergency_care, is_24_7, ambulance, trauma_capability, source_text
EMERGENCY_BRANCHES = (
    (T_ + SP, ("confirmed", True, "confirmed", "claimed", "")),
    (G + DH + C + CO, ("claimed", False, "uncertain", "uncertain", "")),
    (MAT, ("claimed", False, "not_present", "not_present", "")),
)
EMERGENCY_ELSE = ("uncertain", False, "not_present", "not_present", "")

# surgery: general_surgery, appendectomy, caesarean, orthopedic, cardiac, source_text
SURGERY_BRANCHES = (
    (T_, ("confirmed", "confirmed", "confirmed", "claimed", "claimed", "")),
    (SP, ("confirmed", "confirmed", "confirmed", "claimed", "uncertain", "")),
    (G + DH + C, ("claimed", "claimed", "claimed", "uncertain", "not_present", "")),
    (MAT, ("uncertain", "not_present", "confirmed", "not_present", "not_present", "")),
    (CO, ("uncertain", "not_present", "claimed", "not_present", "not_present", "")),
)
SURGERY_ELSE = ("not_present", "not_present", "not_present", "not_present", "not_present", "")

# dialysis: present, machine_count, source_text
DIALYSIS_BRANCHES = (
    (T_, ("confirmed", 4, "")),
    (SP, ("claimed", None, "")),
)
DIALYSIS_ELSE = ("not_present", None, "")

SPECIALTY_BRANCHES = (
    (T_, ["Surgery", "Internal Medicine", "Obstetrics & Gynaecology", "Paediatrics",
          "Anaesthesiology", "Radiology", "Pathology"]),
    (SP, ["Specialist care", "Surgery"]),
    (MAT, ["Obstetrics", "Midwifery", "Postnatal care"]),
    (G + DH + C, ["General Medicine", "Surgery", "Maternity"]),
    (PRIMARY, ["Primary care", "Immunisation", "Antenatal"]),
)

NOTES_PREFIX = "Heuristic inference from category: "

# ---------------------------------------------------------------------------


def _sql_lit(v, field_type) -> str:
    from pyspark.sql import types as T

    if isinstance(field_type, T.ArrayType):
        return "CAST(array(" + ", ".join(_sql_lit(x, T.StringType()) for x in v) + ") AS ARRAY<STRING>)"
    if v is None:
        return f"CAST(NULL AS {field_type.simpleString().upper()})"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"CAST({v} AS INT)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _case(branches, default: str, cat: str, text) -> str:
    """CASE: the first branch whose keywords occur in ``cat``."""
    cases = " ".join("WHEN " + " OR ".join(f"contains({cat}, '{k}')" for k in kws) + f" THEN {text(vals)}" for kws, vals in branches)
    return f"CASE {cases} ELSE {default} END"


def infer_extraction(category: str, func_stats: str) -> Column:
    """Extraction struct (``schemas.EXTRACTION``) from the columns category and functional status.

    Built as one SQL text: a single JVM call instead of one per sub-expression.
    """
    cat_raw, func_raw = f"coalesce(`{category}`, '')", f"coalesce(`{func_stats}`, '')"
    cat = f"lower({cat_raw})"
    special = {FN: f"CASE WHEN lower({func_raw}) IN ('functional', '') THEN 'functional' ELSE 'unknown' END",
               CAT: f"concat('Category: ', {cat_raw})"}

    def section(name: str, branches, default) -> str:
        fields = EXTRACTION[name].dataType.fields

        def build(values) -> str:
            return "named_struct(" + ", ".join(
                f"'{f.name}', {special[v] if v in (FN, CAT) else _sql_lit(v, f.dataType)}" for v, f in zip(values, fields)) + ")"

        return f"'{name}', {_case(branches, build(default), cat, build)}"

    specialties = EXTRACTION["specialties_extracted"].dataType
    return F.expr("named_struct(" + ", ".join((
        section("icu", ICU_BRANCHES, ICU_ELSE), section("ventilator", VENT_BRANCHES, VENT_ELSE),
        section("staff", STAFF_BRANCHES, STAFF_ELSE), section("emergency", EMERGENCY_BRANCHES, EMERGENCY_ELSE),
        section("surgery", SURGERY_BRANCHES, SURGERY_ELSE), section("dialysis", DIALYSIS_BRANCHES, DIALYSIS_ELSE),
        f"'specialties_extracted', {_case(SPECIALTY_BRANCHES, _sql_lit([], specialties), cat, lambda v: _sql_lit(v, specialties))}",
        f"'extraction_notes', concat('{NOTES_PREFIX}', {cat_raw})",
        f"'raw_text_used', concat('Category: ', {cat_raw}, '. Functional: ', {func_raw}, '.')")) + ")").cast(EXTRACTION)
