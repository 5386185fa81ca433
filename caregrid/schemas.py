"""Explicit StructTypes, closed enums and fixed value tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------

AVAILABILITY = ("confirmed", "claimed", "not_present", "uncertain")
STAFF = ("full_time", "part_time", "visiting", "on_call", "unknown")
FUNCTIONAL = ("functional", "non_functional", "partially_functional", "unknown")
FACILITY_TYPES = ("hospital", "clinic", "dentist", "doctor", "pharmacy", "unknown")
PHARMACY_ALIASES = ("farmacy", "pharma", "chemist")
NEEDS = ("emergency", "icu", "maternity", "surgery", "dialysis", "pediatric", "general")

PRESENT = ("confirmed", "claimed")
DETERMINED_AVAIL = ("confirmed", "claimed", "not_present")
DETERMINED_STAFF = ("full_time", "part_time", "visiting", "on_call")
RELIABLE_STAFF = ("full_time", "on_call")

# Missing-value sentinels collapsed to null at the I/O boundary.
MISSING_SENTINELS = ("nan", "<na>", "none", "")

# Raw registry columns kept at ingest, in order.
KEPT_COLUMNS = (
    "name", "phone_numbers", "officialPhone", "email", "websites", "officialWebsite",
    "yearEstablished", "address_line1", "address_line2", "address_line3", "address_city",
    "address_stateOrRegion", "address_zipOrPostcode", "address_country", "facilityTypeId",
    "operatorTypeId", "affiliationTypeIds", "description", "numberDoctors", "capacity",
    "specialties", "procedure", "equipment", "capability", "latitude", "longitude",
)
DOUBLE_COLUMNS = ("latitude", "longitude")
LONG_COLUMNS = ("numberDoctors", "capacity")

# ---------------------------------------------------------------------------
# Nested capability record (Silver)
# ---------------------------------------------------------------------------

# The names and order of the record's fields.
S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()
STR_ARRAY = T.ArrayType(S)

ICU = T.StructType([
    T.StructField("present", S), T.StructField("functional_status", S),
    T.StructField("bed_count", I), T.StructField("neonatal_icu", S), T.StructField("source_text", S),
])
VENTILATOR = T.StructType([
    T.StructField("present", S), T.StructField("count", I),
    T.StructField("reliability_note", S), T.StructField("source_text", S),
])
STAFF_T = T.StructType([
    T.StructField("anesthesiologist", S), T.StructField("surgeon", S),
    T.StructField("general_physician", S), T.StructField("specialist_types", STR_ARRAY),
    T.StructField("total_doctor_count", I), T.StructField("source_text", S),
])
EMERGENCY = T.StructType([
    T.StructField("emergency_care", S), T.StructField("is_24_7", B),
    T.StructField("ambulance", S), T.StructField("trauma_capability", S), T.StructField("source_text", S),
])
SURGERY = T.StructType([
    T.StructField("general_surgery", S), T.StructField("appendectomy", S), T.StructField("caesarean", S),
    T.StructField("orthopedic", S), T.StructField("cardiac", S), T.StructField("source_text", S),
])
DIALYSIS = T.StructType([
    T.StructField("present", S), T.StructField("machine_count", I), T.StructField("source_text", S),
])
EXTRACTION = T.StructType([
    T.StructField("icu", ICU), T.StructField("ventilator", VENTILATOR), T.StructField("staff", STAFF_T),
    T.StructField("emergency", EMERGENCY), T.StructField("surgery", SURGERY), T.StructField("dialysis", DIALYSIS),
    T.StructField("specialties_extracted", STR_ARRAY), T.StructField("extraction_notes", S),
    T.StructField("raw_text_used", S),
])

TRUST_FLAG = T.StructType([
    T.StructField("flag_type", S), T.StructField("severity", S),
    T.StructField("description", S), T.StructField("supporting_evidence", S),
])
CONFIDENCE = T.StructType([
    T.StructField(n, T.DoubleType()) for n in (
        "completeness", "consistency", "reliability", "overall",
        "confidence_interval_low", "confidence_interval_high")
])

SILVER = T.StructType([
    T.StructField("facility_id", S), T.StructField("extraction_json", S),
    T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
])
