"""D2/D3 rule cases (one-row DataFrames built through the reply parser)."""

import json

from pyspark.sql import functions as F

from caregrid.functions.parse import parse_replies
from caregrid.operators.trust import confidence, trust_flags, trust_score_from_flags


def _empty():
    return {
        "icu": {"present": "uncertain"},
        "ventilator": {"present": "uncertain"},
        "staff": {"anesthesiologist": "unknown", "surgeon": "unknown", "general_physician": "unknown",
                  "specialist_types": []},
        "emergency": {"emergency_care": "uncertain", "is_24_7": False},
        "surgery": {"general_surgery": "uncertain", "caesarean": "uncertain", "cardiac": "uncertain"},
        "dialysis": {"present": "uncertain"},
    }


def _score(spark, ext, ftype, doctors, ctl):
    df = spark.createDataFrame([("f1", json.dumps(ext), ftype, doctors, ctl)],
                               "facility_id string, j string, ftype string, doctors long, ctl long")
    p = parse_replies(df, "j", "facility_id")
    p = p.withColumn("flags", trust_flags("extraction", "ftype", "doctors", "ctl"))
    p = p.withColumn("score", trust_score_from_flags("flags")).withColumn(
        "conf", confidence("extraction", "flags", "ctl"))
    r = p.select("score", F.transform("flags", lambda x: x["flag_type"]).alias("ids"), "conf", "errors").first()
    assert r["errors"] == [], r["errors"]
    return r["score"], set(r["ids"]), r["conf"]


def test_uncertain_clinic_not_floored(spark):
    score, ids, _ = _score(spark, _empty(), "clinic", None, 300)
    assert "MISSING_CRITICAL_FIELDS" in ids
    assert score == 0.9


def test_surgery_without_anesthesiologist(spark):
    ext = _empty()
    ext["surgery"]["general_surgery"] = "claimed"
    score, ids, _ = _score(spark, ext, "hospital", 10, 600)
    assert "SURGERY_NO_ANESTHESIOLOGIST" in ids
    assert score == 0.63


def test_caesarean_without_anesthesiologist(spark):
    ext = _empty()
    ext["surgery"]["caesarean"] = "confirmed"
    _, ids, _ = _score(spark, ext, "hospital", 10, 600)
    assert "CAESAREAN_NO_ANESTHESIOLOGIST" in ids


def test_cardiac_tier(spark):
    ext = _empty()
    ext["surgery"]["cardiac"] = "claimed"
    assert "CARDIAC_SURGERY_LOW_TIER" in _score(spark, ext, "clinic", 5, 600)[1]
    assert "CARDIAC_SURGERY_LOW_TIER" not in _score(spark, ext, "hospital", 5, 600)[1]


def test_ventilator_without_icu(spark):
    ext = _empty()
    ext["ventilator"]["present"] = "claimed"
    assert "VENTILATOR_NO_ICU" not in _score(spark, ext, "hospital", 5, 600)[1]
    ext["icu"]["present"] = "not_present"
    assert "VENTILATOR_NO_ICU" in _score(spark, ext, "hospital", 5, 600)[1]


def test_24_7_needs_emergency_care(spark):
    ext = _empty()
    ext["emergency"]["is_24_7"] = True
    assert "24_7_NO_STAFF" not in _score(spark, ext, "hospital", 5, 600)[1]
    ext["emergency"]["emergency_care"] = "claimed"
    assert "24_7_NO_STAFF" in _score(spark, ext, "hospital", 5, 600)[1]


def test_confidence_bounds(spark):
    ext = _empty()
    ext["icu"]["present"] = "confirmed"
    ext["staff"]["anesthesiologist"] = "full_time"
    ext["emergency"]["emergency_care"] = "confirmed"
    _, _, conf = _score(spark, ext, "hospital", 20, 2000)
    assert 0.0 <= conf["overall"] <= 1.0
    assert conf["completeness"] >= 0.5
    assert conf["confidence_interval_low"] <= conf["overall"] <= conf["confidence_interval_high"]


def test_trust_floor_property(spark):
    """Every rule firing at once still scores above the 0.05 floor (product is 0.158)."""
    ext = {
        "icu": {"present": "confirmed", "functional_status": "non_functional", "bed_count": 0},
        "ventilator": {"present": "claimed"},
        "staff": {"anesthesiologist": "unknown", "surgeon": "unknown", "general_physician": "unknown",
                  "specialist_types": ["a", "b", "c", "d"]},
        "emergency": {"emergency_care": "claimed", "is_24_7": True},
        "surgery": {"general_surgery": "claimed", "caesarean": "claimed", "cardiac": "claimed"},
        "dialysis": {"present": "uncertain"},
    }
    score, ids, _ = _score(spark, ext, "clinic", None, 10)
    # ICU confirmed excludes rule 7 (needs not_present); 4 of 6 fields determined excludes rule 9
    assert len(ids) == 8
    assert score == 0.195 and score > 0.05  # .7*.8*.9*.8*.8*.85*.75*.95
