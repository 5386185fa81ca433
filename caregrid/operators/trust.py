"""D2 trust rules, D3 confidence, D5 heuristic adjustments.

The rule engine is a list of (flag, severity, penalty, predicate, evidence)
entries evaluated as column expressions: flags = the fired entries in rule
order, score = product of (1 - penalty) over fired entries, clamped and
rounded. No UDFs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from caregrid.functions.core import (
    col, in_set, is_present, rnd,
)
from caregrid.schemas import DETERMINED_AVAIL, DETERMINED_STAFF, RELIABLE_STAFF


@dataclass(frozen=True)
class TrustRule:
    rule_id: str
    severity: str
    description: str
    penalty: float


# Rule ids, severities, descriptions, penalties (rule order matters).
TRUST_RULES = (
    TrustRule("SURGERY_NO_ANESTHESIOLOGIST", "CRITICAL",
              "Surgery capability claimed but no anesthesiologist on staff", 0.30),
    TrustRule("ICU_NON_FUNCTIONAL", "HIGH", "ICU listed as present but marked non-functional", 0.20),
    TrustRule("ICU_CONFIRMED_NO_BEDS", "MEDIUM", "ICU confirmed but no bed count provided", 0.10),
    TrustRule("24_7_NO_STAFF", "HIGH",
              "24/7 emergency claimed but no full-time or on-call doctor documented", 0.20),
    TrustRule("CARDIAC_SURGERY_LOW_TIER", "HIGH",
              "Cardiac surgery claimed at a non-hospital facility (clinic/dentist/doctor/pharmacy)", 0.20),
    TrustRule("NO_DOCTORS_MANY_SPECIALTIES", "MEDIUM", "Zero or unknown doctors but >3 specialties claimed", 0.15),
    TrustRule("VENTILATOR_NO_ICU", "MEDIUM", "Ventilators claimed but ICU explicitly absent", 0.10),
    TrustRule("CAESAREAN_NO_ANESTHESIOLOGIST", "HIGH", "C-section claimed but no anesthesiologist documented", 0.25),
    TrustRule("MISSING_CRITICAL_FIELDS", "LOW", "Fewer than 3 of 6 core capability fields could be determined", 0.10),
    TrustRule("EMPTY_DESCRIPTION", "LOW", "Source description is empty or trivial", 0.05),
)
RULES = {r.rule_id: r for r in TRUST_RULES}


def _fields(ex: Column) -> dict[str, Column]:
    """Typed accessors with the reference defaults for missing values."""
    d = {
        "icu_present": F.coalesce(ex["icu"]["present"], F.lit("uncertain")),
        "icu_functional": F.coalesce(ex["icu"]["functional_status"], F.lit("unknown")),
        "bed_count": ex["icu"]["bed_count"],
        "anest": F.coalesce(ex["staff"]["anesthesiologist"], F.lit("unknown")),
        "surgeon": F.coalesce(ex["staff"]["surgeon"], F.lit("unknown")),
        "gp": F.coalesce(ex["staff"]["general_physician"], F.lit("unknown")),
        "n_specialist_types": F.coalesce(F.size(ex["staff"]["specialist_types"]), F.lit(0)),
        "total_doctors": ex["staff"]["total_doctor_count"],
        "surgery_general": F.coalesce(ex["surgery"]["general_surgery"], F.lit("uncertain")),
        "caesarean": F.coalesce(ex["surgery"]["caesarean"], F.lit("uncertain")),
        "cardiac": F.coalesce(ex["surgery"]["cardiac"], F.lit("uncertain")),
        "is_24_7": F.coalesce(ex["emergency"]["is_24_7"], F.lit(False)),
        "emergency": F.coalesce(ex["emergency"]["emergency_care"], F.lit("uncertain")),
        "vent": F.coalesce(ex["ventilator"]["present"], F.lit("uncertain")),
        "dialysis": F.coalesce(ex["dialysis"]["present"], F.lit("uncertain")),
    }
    # fields with size(null) -> -1 in legacy mode guarded above
    d["n_specialist_types"] = F.greatest(d["n_specialist_types"], F.lit(0))
    return d


def determined_count(ex: Column) -> Column:
    f = _fields(ex)
    terms = [
        in_set(f["icu_present"], DETERMINED_AVAIL), in_set(f["vent"], DETERMINED_AVAIL),
        in_set(f["anest"], DETERMINED_STAFF), in_set(f["emergency"], DETERMINED_AVAIL),
        in_set(f["surgery_general"], DETERMINED_AVAIL), in_set(f["dialysis"], DETERMINED_AVAIL),
    ]
    total = None
    for t in terms:
        v = t.cast("int")
        total = v if total is None else total + v
    return total


def _flag_is(rule_id: str):
    return lambda x: x["flag_type"] == rule_id


def raw_score_from_flags(flags: str | Column) -> Column:
    """Product of (1 - penalty) over the fired rules, in rule order (unclamped)."""
    flags = col(flags)
    score = F.lit(1.0)
    for r in TRUST_RULES:
        fired = F.exists(flags, _flag_is(r.rule_id))
        score = score * F.when(fired, F.lit(1.0 - r.penalty)).otherwise(F.lit(1.0))
    return score


def trust_score_from_flags(flags: str | Column) -> Column:
    """D2 score: clamp(product, 0.05, 1.0), round 3 HALF_UP."""
    return rnd(F.greatest(F.lit(0.05), F.least(F.lit(1.0), raw_score_from_flags(flags))), 3)


def confidence(ex: str | Column, flags: str | Column, ctl: str | Column) -> Column:
    """D3: completeness, consistency, reliability, overall and a noise band."""
    ex, flags, ctl = col(ex), col(flags), col(ctl)
    completeness = determined_count(ex).cast("double") / F.lit(6.0)
    high = F.size(F.filter(flags, lambda x: x["severity"].isin("HIGH", "CRITICAL")))
    med = F.size(F.filter(flags, lambda x: x["severity"] == "MEDIUM"))
    consistency = F.greatest(F.lit(0.0), F.lit(1.0) - high * F.lit(0.25) - med * F.lit(0.10))
    reliability = (
        F.when(ctl > 1000, F.lit(0.85)).when(ctl > 400, F.lit(0.65)).when(ctl > 100, F.lit(0.45))
        .otherwise(F.lit(0.20))
    )
    overall_raw = F.lit(0.40) * completeness + F.lit(0.35) * consistency + F.lit(0.25) * reliability
    overall = rnd(overall_raw, 3)
    noise = F.lit(0.05) + F.least(F.lit(0.20), F.size(flags) * F.lit(0.02))
    return F.struct(
        rnd(completeness, 3).alias("completeness"),
        rnd(consistency, 3).alias("consistency"),
        rnd(reliability, 3).alias("reliability"),
        overall.alias("overall"),
        rnd(F.greatest(F.lit(0.0), overall - noise), 3).alias("confidence_interval_low"),
        rnd(F.least(F.lit(1.0), overall + noise), 3).alias("confidence_interval_high"),
    )


def heuristic_adjust(score: str | Column, category: str | Column, func_status: str | Column) -> Column:
    """x1.25 teaching/federal medical or x1.10 specialist (cap 1), then x0.40 not functional
    or x0.70 partially functional (floor 0.05), round 3."""
    score = col(score)
    cat = F.lower(F.coalesce(col(category), F.lit("")))
    func = F.lower(F.coalesce(col(func_status), F.lit("")))
    boosted = (
        F.when(cat.contains("teaching") | cat.contains("federal medical"), F.least(F.lit(1.0), score * F.lit(1.25)))
        .when(cat.contains("specialist"), F.least(F.lit(1.0), score * F.lit(1.10)))
        .otherwise(score)
    )
    penalised = (
        F.when(func == "not functional", F.greatest(F.lit(0.05), boosted * F.lit(0.40)))
        .when(func == "partially functional", F.greatest(F.lit(0.05), boosted * F.lit(0.70)))
        .otherwise(boosted)
    )
    return rnd(penalised, 3)


def working_icu(ex: str | Column) -> Column:
    """ICU present and not marked non-functional; missing record -> false."""
    ex = col(ex)
    return F.coalesce(
        is_present(ex["icu"]["present"]) & (F.coalesce(ex["icu"]["functional_status"], F.lit("")) != "non_functional"),
        F.lit(False),
    )


def flags_text(flags: str | Column) -> Column:
    """Flag types joined by ',' (flat output form)."""
    return F.array_join(F.transform(col(flags), lambda x: x["flag_type"]), ",")


def n_high_flags(flags: str | Column) -> Column:
    return F.size(F.filter(col(flags), lambda x: x["severity"].isin("HIGH", "CRITICAL")))


__all__ = [
    "TRUST_RULES", "trust_flags", "trust_score_from_flags", "confidence", "heuristic_adjust",
    "working_icu", "flags_text", "determined_count", "n_high_flags", "raw_score_from_flags",
]


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trust_flags(ex: str, facility_type: str, number_doctors: str | None, ctl: str) -> Column:
    """D2 flags: array<struct<flag_type, severity, description, supporting_evidence>> in rule order.

    Takes column names and builds one SQL text: a single JVM call instead of one per sub-expression.
    """
    e = f"`{ex}`"
    ft = f"coalesce(`{facility_type}`, 'unknown')"
    nd = "CAST(NULL AS BIGINT)" if number_doctors is None else f"CAST(`{number_doctors}` AS BIGINT)"
    c = f"`{ctl}`"
    P = "('confirmed', 'claimed')"
    f = {
        "icu": f"coalesce({e}.icu.present, 'uncertain')",
        "icu_fn": f"coalesce({e}.icu.functional_status, 'unknown')",
        "beds": f"{e}.icu.bed_count",
        "anest": f"coalesce({e}.staff.anesthesiologist, 'unknown')",
        "surgeon": f"coalesce({e}.staff.surgeon, 'unknown')",
        "gp": f"coalesce({e}.staff.general_physician, 'unknown')",
        "nspec": f"greatest(coalesce(size({e}.staff.specialist_types), 0), 0)",
        "total": f"coalesce(CAST({e}.staff.total_doctor_count AS BIGINT), {nd})",
        "sg": f"coalesce({e}.surgery.general_surgery, 'uncertain')",
        "caes": f"coalesce({e}.surgery.caesarean, 'uncertain')",
        "card": f"coalesce({e}.surgery.cardiac, 'uncertain')",
        "h24": f"coalesce({e}.emergency.is_24_7, false)",
        "em": f"coalesce({e}.emergency.emergency_care, 'uncertain')",
        "vent": f"coalesce({e}.ventilator.present, 'uncertain')",
        "dial": f"coalesce({e}.dialysis.present, 'uncertain')",
    }
    pres = lambda x: f"coalesce({x} IN {P}, false)"
    det = " + ".join(f"CAST(coalesce({f[k]} IN {s}, false) AS INT)" for k, s in (
        ("icu", "('confirmed', 'claimed', 'not_present')"), ("vent", "('confirmed', 'claimed', 'not_present')"),
        ("anest", "('full_time', 'part_time', 'visiting', 'on_call')"), ("em", "('confirmed', 'claimed', 'not_present')"),
        ("sg", "('confirmed', 'claimed', 'not_present')"), ("dial", "('confirmed', 'claimed', 'not_present')")))
    unreliable = lambda x: f"NOT coalesce({x} IN ('full_time', 'on_call'), false)"
    rules = [
        ("SURGERY_NO_ANESTHESIOLOGIST", f"{pres(f['sg'])} AND {f['anest']} = 'unknown'",
         f"concat('surgery.general_surgery=', {f['sg']}, ', staff.anesthesiologist=unknown')"),
        ("ICU_NON_FUNCTIONAL", f"{pres(f['icu'])} AND {f['icu_fn']} = 'non_functional'",
         f"concat('icu.present=', {f['icu']}, ', functional=', {f['icu_fn']})"),
        ("ICU_CONFIRMED_NO_BEDS", f"{f['icu']} = 'confirmed' AND coalesce({f['beds']} = 0, true)",
         "'ICU confirmed but bed_count missing/zero'"),
        ("24_7_NO_STAFF", f"{f['h24']} AND {pres(f['em'])} AND {unreliable(f['gp'])} AND {unreliable(f['surgeon'])}",
         f"concat('is_24_7=True, gp=', {f['gp']}, ', surgeon=', {f['surgeon']})"),
        ("CARDIAC_SURGERY_LOW_TIER", f"{pres(f['card'])} AND {ft} <> 'hospital'",
         f"concat('surgery.cardiac=', {f['card']}, ', facility_type=', {ft})"),
        ("NO_DOCTORS_MANY_SPECIALTIES", f"coalesce({f['total']} <= 1, true) AND {f['nspec']} > 3",
         f"concat('total_doctors=', coalesce(CAST({f['total']} AS STRING), 'None'), ', specialties=', CAST({f['nspec']} AS STRING))"),
        ("VENTILATOR_NO_ICU", f"{pres(f['vent'])} AND {f['icu']} = 'not_present'",
         f"concat('ventilator=', {f['vent']}, ', icu=', {f['icu']})"),
        ("CAESAREAN_NO_ANESTHESIOLOGIST", f"{pres(f['caes'])} AND {f['anest']} = 'unknown'",
         f"concat('caesarean=', {f['caes']}, ', anest=unknown')"),
        ("MISSING_CRITICAL_FIELDS", f"({det}) < 3", f"concat('determined=', CAST(({det}) AS STRING), '/6')"),
        ("EMPTY_DESCRIPTION", f"{c} < 60", f"concat('composite_text_length=', CAST({c} AS STRING))"),
    ]
    items = []
    for rid, pred, ev in rules:
        r = RULES[rid]
        items.append(f"CASE WHEN {pred} THEN named_struct('flag_type', {_q(r.rule_id)}, 'severity', {_q(r.severity)}, "
                     f"'description', {_q(r.description)}, 'supporting_evidence', {ev}) END")
    return F.expr(f"filter(array({', '.join(items)}), x -> x IS NOT NULL)")
