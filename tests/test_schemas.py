"""P8 normaliser and X1-X6 parsing cases."""

import json

from pyspark.sql import functions as F

from caregrid.functions.parse import parse_replies
from caregrid.functions.text import normalise_facility_type, query_intents


def test_facility_type_normalise(spark):
    df = spark.createDataFrame([("farmacy",), ("pharmacy",), (None,), ("CLINIC",), ("not-a-thing",)], "t string")
    got = [r[0] for r in df.select(normalise_facility_type("t")).collect()]
    assert got == ["pharmacy", "pharmacy", "unknown", "clinic", "unknown"]


def _parse(spark, text):
    df = spark.createDataFrame([("given-id", text)], "facility_id string, raw string")
    return parse_replies(df, "raw", "facility_id").first()


def test_defaults_string_int_and_json_list(spark):
    payload = {"icu": {"present": "claimed", "bed_count": "12"},
               "staff": {"specialist_types": '["cardiology", "oncology"]'}}
    r = _parse(spark, json.dumps(payload))
    ex = r["extraction"]
    assert ex["icu"]["bed_count"] == 12
    assert ex["staff"]["specialist_types"] == ["cardiology", "oncology"]
    assert ex["ventilator"]["present"] == "uncertain"
    assert ex["staff"]["surgeon"] == "unknown"


def test_bad_enum_rejects_row(spark):
    r = _parse(spark, json.dumps({"icu": {"present": "definitely_yes"}}))
    assert r["extraction"] is None and r["errors"]


def test_given_id_wins(spark):
    r = _parse(spark, json.dumps({"facility_id": "model-said", "icu": {"present": "claimed"}}))
    assert r["facility_id"] == "given-id" and r["extraction"] is not None


def test_comma_list(spark):
    r = _parse(spark, json.dumps({"staff": {"specialist_types": "cardiology, oncology, , urology"}}))
    assert r["extraction"]["staff"]["specialist_types"] == ["cardiology", "oncology", "urology"]


def test_nan_count(spark):
    r = _parse(spark, json.dumps({"icu": {"bed_count": "nan"}, "dialysis": {"machine_count": "5.7"}}))
    assert r["extraction"]["icu"]["bed_count"] is None
    assert r["extraction"]["dialysis"]["machine_count"] == 5


def test_fences(spark):
    body = json.dumps({"icu": {"present": "confirmed"}})
    for text in (body, "```json\n" + body + "\n```", "```\n" + body + "```", "  ```JSON\n" + body):
        assert _parse(spark, text)["extraction"]["icu"]["present"] == "confirmed", text
    assert _parse(spark, "Sure:\n```json\n" + body + "\n```")["extraction"] is None
    assert _parse(spark, "[1, 2]")["extraction"] is None


def test_null_section_rejects(spark):
    assert _parse(spark, '{"icu": null}')["extraction"] is None


def test_intent_substring_hazards(spark):
    df = spark.createDataFrame([("need to prevent water loss",), ("NICU for my baby",)], "q string")
    got = [r[0] for r in df.select(query_intents("q")).collect()]
    assert got[0] == ["ventilator", "emergency"]  # 'vent' in prevent, 'er ' in water
    assert got[1] == ["icu", "neonatal"]


def test_x1_list_reply_is_failure(spark):
    r = _parse(spark, "[3]")
    assert r["errors"] == ["JSON is not an object"]
    _ = F
