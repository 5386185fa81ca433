"""Model-reply parsing and relaxed validation to the typed capability record.

All JVM-side: the reply text is unwrapped from a Markdown fence (X1), parsed
once with ``try_parse_json`` into a VARIANT, and every field is read with
``try_variant_get`` + ``schema_of_variant`` type tests. Missing keys take the
record defaults; JSON null for a section or enum, an out-of-set enum, a
non-string text field or an over-long source text rejects the whole row with a
reason (X3); counts coerce leniently (X4); lists coerce per X5/X6.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caregrid.functions.core import col, compact
from caregrid.schemas import AVAILABILITY, EXTRACTION, FUNCTIONAL, STAFF

INT_SENTINELS = ("null", "none", "n/a", "nan", "")
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")
MAX_SOURCE_TEXT = 2000

# field -> (enum values, default) for the enum-typed fields of each section
ENUM_FIELDS = {
    "icu": {"present": (AVAILABILITY, "uncertain"), "functional_status": (FUNCTIONAL, "unknown"),
            "neonatal_icu": (AVAILABILITY, "uncertain")},
    "ventilator": {"present": (AVAILABILITY, "uncertain")},
    "staff": {"anesthesiologist": (STAFF, "unknown"), "surgeon": (STAFF, "unknown"),
              "general_physician": (STAFF, "unknown")},
    "emergency": {"emergency_care": (AVAILABILITY, "uncertain"), "ambulance": (AVAILABILITY, "uncertain"),
                  "trauma_capability": (AVAILABILITY, "uncertain")},
    "surgery": {k: (AVAILABILITY, "uncertain") for k in
                ("general_surgery", "appendectomy", "caesarean", "orthopedic", "cardiac")},
    "dialysis": {"present": (AVAILABILITY, "uncertain")},
}
INT_FIELDS = {"icu": ("bed_count",), "ventilator": ("count",), "staff": ("total_doctor_count",),
              "dialysis": ("machine_count",)}
TEXT_FIELDS = {"icu": ("source_text",), "ventilator": ("reliability_note", "source_text"),
               "staff": ("source_text",), "emergency": ("source_text",), "surgery": ("source_text",),
               "dialysis": ("source_text",)}
SECTIONS = ("icu", "ventilator", "staff", "emergency", "surgery", "dialysis")

_WS = r"^\s+|\s+$"


def strip_ws(c: Column) -> Column:
    """Python's str.strip() for ASCII whitespace."""
    return F.regexp_replace(c, _WS, "")


def unfence(text: str | Column) -> Column:
    """Remove a leading Markdown fence and an optional 'json' tag line; text before a
    fence is left as is (and then fails to parse)."""
    c = strip_ws(F.coalesce(col(text), F.lit("")))
    inner = F.regexp_extract(c, r"(?s)^```(.*?)(?:```|$)", 1)
    tagged = F.lower(F.ltrim(F.regexp_replace(inner, r"^\s+", ""))).startswith("json")
    inner = F.when(tagged, F.when(inner.contains("\n"), F.regexp_replace(inner, r"^[^\n]*\n", ""))
                   .otherwise(F.lit(""))).otherwise(inner)
    return F.when(c.startswith("```"), strip_ws(inner)).otherwise(c)


def _vtype(v: Column) -> Column:
    """Variant type name of a value: STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, OBJECT<..>, ARRAY<..>, VOID; null if missing."""
    return F.schema_of_variant(v)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is_number(t: Column) -> Column:
    return t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")


def coerce_int(v: Column) -> Column:
    """Bool -> null; number -> truncated; numeric text -> truncated; sentinels/garbage/inf -> null."""
    t = _vtype(v)
    as_txt = strip_ws(F.try_variant_get(v, "$", "string"))
    from_txt = F.when(F.lower(as_txt).isin(*INT_SENTINELS), F.lit(None).cast("double")).otherwise(
        as_txt.try_cast("double"))
    d = F.when(_is_number(t), F.try_variant_get(v, "$", "double")).when(t == "STRING", from_txt)
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None).cast("int")).otherwise(d.try_cast("int"))


def _str_items(arr_v: Column) -> Column:
    """List items as trimmed, non-blank strings (numbers/bools via their JSON text)."""
    items = F.try_variant_get(arr_v, "$", "array<variant>")
    txt = F.transform(items, lambda x: F.when(_vtype(x) == "BOOLEAN",
                                              F.when(F.try_variant_get(x, "$", "boolean"), F.lit("True"))
                                              .otherwise(F.lit("False")))
                      .when(_vtype(x) == "VOID", F.lit("None"))
                      .otherwise(strip_ws(F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))))
    return F.filter(txt, lambda s: s != "")


def coerce_list(v: Column, comma_split: bool) -> Column:
    """X5 (comma_split=True) / X6 (False): list -> trimmed non-blank items; JSON-list text -> its items;
    other valid JSON text -> []; other text -> comma split (X5) or [] (X6); anything else -> []."""
    empty = F.array().cast("array<string>")
    t = _vtype(v)
    s = strip_ws(F.try_variant_get(v, "$", "string"))
    inner = F.try_parse_json(s)
    it = _vtype(inner)
    from_text = (
        F.when(s == "", empty)
        .when(it.startswith("ARRAY"), _str_items(inner))
        .when(inner.isNotNull(), empty)
    )
    if comma_split:
        from_text = from_text.otherwise(F.filter(F.transform(F.split(s, ","), lambda x: strip_ws(x)), lambda x: x != ""))
    else:
        from_text = from_text.otherwise(empty)
    return F.when(t.startswith("ARRAY"), _str_items(v)).when(t == "STRING", from_text).otherwise(empty)


def _bool(v: Column, default: bool):
    """Lax bool: true/false, 0/1, the usual words; missing -> default; null or other -> error."""
    t = _vtype(v)
    s = F.lower(strip_ws(F.try_variant_get(v, "$", "string")))
    val = (F.when(t.isNull(), F.lit(default))
           .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
           .when(_is_number(t) & s.isin("0", "1", "0.0", "1.0"), s.isin("1", "1.0"))
           .when((t == "STRING") & s.isin(*TRUE_WORDS), F.lit(True))
           .when((t == "STRING") & s.isin(*FALSE_WORDS), F.lit(False)))
    err = F.when(t.isNotNull() & val.isNull(), F.lit("invalid boolean"))
    return val, err


def validate(reply_json: Column, facility_id: Column) -> tuple[Column, Column]:
    """X2 + X3: (extraction struct or null, array of error strings) for a parsed reply (VARIANT)."""
    v = reply_json
    errors = [F.when(v.isNull(), F.lit("invalid JSON")),
              F.when(v.isNotNull() & ~F.coalesce(_vtype(v).startswith("OBJECT"), F.lit(False)),
                     F.lit("JSON is not an object"))]
    sections = []
    for sec in SECTIONS:
        sv = _get(v, f"$.{sec}")
        st = _vtype(sv)
        errors.append(F.when(st.isNotNull() & ~st.startswith("OBJECT"), F.lit(f"{sec}: not an object")))
        fields = []
        for f in EXTRACTION[sec].dataType.fields:
            fv = _get(v, f"$.{sec}.{f.name}")
            ft = _vtype(fv)
            if f.name in ENUM_FIELDS.get(sec, {}):
                allowed, default = ENUM_FIELDS[sec][f.name]
                raw = F.when(ft == "STRING", F.try_variant_get(fv, "$", "string"))
                val = F.when(ft.isNull(), F.lit(default)).otherwise(raw)
                errors.append(F.when(ft.isNotNull() & ~F.coalesce(raw.isin(*allowed), F.lit(False)),
                                     F.lit(f"{sec}.{f.name}: invalid value")))
                fields.append(val.alias(f.name))
            elif f.name in INT_FIELDS.get(sec, ()):
                fields.append(coerce_int(fv).alias(f.name))
            elif f.name in TEXT_FIELDS.get(sec, ()):
                txt = F.try_variant_get(fv, "$", "string")
                errors.append(F.when(ft.isNotNull() & (ft != "VOID") & (ft != "STRING"),
                                     F.lit(f"{sec}.{f.name}: not a string")))
                if f.name == "source_text":
                    errors.append(F.when((ft == "STRING") & (F.length(txt) > MAX_SOURCE_TEXT),
                                         F.lit(f"{sec}.{f.name}: too long")))
                fields.append(F.when(ft == "STRING", txt).alias(f.name))
            elif f.name == "specialist_types":
                fields.append(coerce_list(fv, comma_split=True).alias(f.name))
            elif f.name == "is_24_7":
                val, err = _bool(fv, False)
                errors.append(err)
                fields.append(val.alias(f.name))
        sections.append(F.struct(*fields).alias(sec))
    nt = _vtype(_get(v, "$.extraction_notes"))
    rt = _vtype(_get(v, "$.raw_text_used"))
    errors.append(F.when(nt.isNotNull() & (nt != "VOID") & (nt != "STRING"), F.lit("extraction_notes: not a string")))
    errors.append(F.when(rt.isNotNull() & (rt != "STRING"), F.lit("raw_text_used: not a string")))
    ex = F.struct(
        *sections,
        coerce_list(_get(v, "$.specialties_extracted"), comma_split=False).alias("specialties_extracted"),
        F.when(nt == "STRING", F.try_variant_get(v, "$.extraction_notes", "string")).alias("extraction_notes"),
        F.when(rt.isNull(), F.lit("")).otherwise(F.try_variant_get(v, "$.raw_text_used", "string"))
        .alias("raw_text_used"),
    ).cast(EXTRACTION)
    errs = compact(*errors)
    return F.when(F.size(errs) == 0, ex), errs


def parse_replies(df, text_col: str = "raw_response", id_col: str = "facility_id"):
    """X1 + X2 over a DataFrame: adds body, extraction (null on failure) and errors.

    The reply is unfenced and parsed into a VARIANT column in its own projection
    (an expensive expression Catalyst will not inline into every field read), then
    every field is read from that column. The facility id is always the caller's.
    """
    staged = df.withColumn("body", unfence(text_col)).withColumn("_v", F.try_parse_json("body"))
    ex, errs = validate(F.col("_v"), F.col(id_col))
    return staged.withColumn("extraction", ex).withColumn("errors", errs).drop("_v")


def parse_ranking(df, text_col: str = "content"):
    """X15 over a DataFrame: adds ``reply`` (query_interpretation, ranked_results, recommendation_summary,
    uncertainty_note; null on failure) and ``errors``; the raw text stays in ``text_col``.

    Each ranked item needs an integer rank, a facility id and name, a suitability in [0, 1] and a reasoning
    text; lists default to [] and the envelope's texts to ''.
    """
    v = F.col("_v")
    t = _vtype(v)
    results = _get(v, "$.ranked_results")
    items = F.try_variant_get(v, "$.ranked_results", "array<variant>")

    def item(x):
        return F.struct(
            F.try_variant_get(x, "$.rank", "int").alias("rank"),
            F.try_variant_get(x, "$.facility_id", "string").alias("facility_id"),
            F.try_variant_get(x, "$.facility_name", "string").alias("facility_name"),
            F.try_variant_get(x, "$.suitability_score", "double").alias("suitability_score"),
            F.try_variant_get(x, "$.reasoning", "string").alias("reasoning"),
            coerce_list(F.try_variant_get(x, "$.matched_capabilities", "variant"), False).alias("matched_capabilities"),
            coerce_list(F.try_variant_get(x, "$.warnings", "variant"), False).alias("warnings"),
            coerce_list(F.try_variant_get(x, "$.citations", "variant"), False).alias("citations"),
        )

    parsed = F.transform(F.coalesce(items, F.array().cast("array<variant>")), item)
    bad = F.exists("_items", lambda r: r["rank"].isNull() | r["facility_id"].isNull() | r["facility_name"].isNull()
                   | r["reasoning"].isNull() | r["suitability_score"].isNull()
                   | (r["suitability_score"] < 0) | (r["suitability_score"] > 1))
    texts = ("query_interpretation", "recommendation_summary", "uncertainty_note")
    errs = compact(
        F.when(v.isNull(), F.lit("invalid JSON")),
        F.when(v.isNotNull() & ~F.coalesce(t.startswith("OBJECT"), F.lit(False)), F.lit("JSON is not an object")),
        F.when(results.isNotNull() & ~_vtype(results).startswith("ARRAY"), F.lit("ranked_results: not a list")),
        F.when(bad, F.lit("invalid ranked result")),
        *[F.when(_get(v, f"$.{n}").isNotNull() & (_vtype(_get(v, f"$.{n}")) != "STRING"), F.lit(f"{n}: not a string")) for n in texts])
    text = lambda n: F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")).alias(n)
    staged = df.withColumn("_v", F.try_parse_json(unfence(text_col))).withColumn("_items", parsed).withColumn("errors", errs)
    reply = F.struct(text(texts[0]), F.col("_items").alias("ranked_results"), text(texts[1]), text(texts[2]))
    return staged.withColumn("reply", F.when(F.size("errors") == 0, reply)).drop("_v", "_items")
