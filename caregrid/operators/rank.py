"""Free-text query ranking: intents (X10), intent satisfaction (D13), the deterministic
ranker (D14), candidate re-validation (J5), summaries (X12), enrichment (J6),
the query pipeline (D15) and its per-query counters (A17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caregrid.config import DEFAULT, Params
from caregrid.functions.core import col, rnd, trust_grade
from caregrid.functions.text import query_intents

SPECIALTY_INTENTS = ("maternity", "cardiac", "orthopedic", "neonatal", "dentist", "pharmacy")
SURGERY_KEYS = ("general_surgery", "appendectomy", "caesarean", "orthopedic", "cardiac")


def _pres(v: Column) -> Column:
    return F.coalesce(F.lower(v).isin("confirmed", "claimed"), F.lit(False))


def _nz(v: Column) -> Column:
    """Python truthiness of an optional int."""
    return F.coalesce(v != 0, F.lit(False))


def intent_matched(i: Column, ex: Column) -> Column:
    """D13 predicate for one intent tag."""
    specs_l = F.transform(F.coalesce(ex["specialties_extracted"], F.array().cast("array<string>")), lambda s: F.lower(s))
    listed = F.exists(specs_l, lambda s: s.contains(i))
    surg_any = None
    for k in SURGERY_KEYS:
        t = _pres(ex["surgery"][k])
        surg_any = t if surg_any is None else surg_any | t
    return (
        F.when(i == "icu", _pres(ex["icu"]["present"]))
        .when(i == "ventilator", _pres(ex["ventilator"]["present"]))
        .when(i == "dialysis", _pres(ex["dialysis"]["present"]))
        .when(i == "emergency", _pres(ex["emergency"]["emergency_care"]))
        .when(i == "trauma", _pres(ex["emergency"]["trauma_capability"]))
        .when(i == "surgery", surg_any)
        .when(i == "ambulance", _pres(ex["emergency"]["ambulance"]))
        .when(i.isin(*SPECIALTY_INTENTS),
              listed | ((i == "neonatal") & _pres(ex["icu"]["neonatal_icu"]))
              | ((i == "cardiac") & _pres(ex["surgery"]["cardiac"])))
        .otherwise(F.lit(False))
    )


def intent_evidence(i: Column, ex: Column) -> Column:
    """D13 evidence phrase for a matched intent tag. The phrases are fixed values."""
    beds = ex["icu"]["bed_count"]
    vn = ex["ventilator"]["count"]
    mn = ex["dialysis"]["machine_count"]
    specs_l = F.transform(F.coalesce(ex["specialties_extracted"], F.array().cast("array<string>")), lambda s: F.lower(s))
    listed = F.exists(specs_l, lambda s: s.contains(i))
    surgery_first = None
    for k in SURGERY_KEYS:
        label = F.lit("Surgery: " + k.replace("_", " "))
        cond = _pres(ex["surgery"][k])
        surgery_first = F.when(cond, label) if surgery_first is None else surgery_first.when(cond, label)
    return (
        F.when(i == "icu", F.concat(F.lit("ICU available"),
                                    F.when(_nz(beds), F.concat(F.lit(" ("), beds.cast("string"), F.lit(" beds)")))
                                    .otherwise(F.lit(""))))
        .when(i == "ventilator", F.concat(
            F.lit("Ventilator"), F.when(F.coalesce(vn, F.lit(0)) != 1, F.lit("s")).otherwise(F.lit("")),
            F.lit(" on site"), F.when(_nz(vn), F.concat(F.lit(" (n="), vn.cast("string"), F.lit(")"))).otherwise(F.lit(""))))
        .when(i == "dialysis", F.concat(F.lit("Dialysis service"),
                                        F.when(_nz(mn), F.concat(F.lit(" ("), mn.cast("string"), F.lit(" machines)")))
                                        .otherwise(F.lit(""))))
        .when(i == "emergency", F.when(F.coalesce(ex["emergency"]["is_24_7"], F.lit(False)), F.lit("24/7 emergency care"))
              .otherwise(F.lit("Emergency care available")))
        .when(i == "trauma", F.lit("Trauma capability"))
        .when(i == "surgery", surgery_first.otherwise(F.lit("")))
        .when(i == "ambulance", F.lit("Ambulance service"))
        .when(listed, F.concat(F.lit("Listed specialty: "), i))
        .when(i == "neonatal", F.lit("Neonatal ICU"))
        .when(i == "cardiac", F.lit("Cardiac surgery available"))
        .otherwise(F.lit(""))
    )


def fmt2(x: Column) -> Column:
    return F.format_string("%.2f", rnd(x, 2))


def candidate_summary(meta: DataFrame) -> DataFrame:
    """Compact candidate record (location text, capability subset, first 10 specialties,
    three source texts, confidence.overall)."""
    ex = F.col("extraction")
    return meta.select(
        *[c for c in ("query_id", "retrieval_rank") if c in meta.columns], "facility_id", "name",
        F.concat(F.coalesce("address_city", F.lit("")), F.lit(", "), F.coalesce("address_state", F.lit("")),
                 F.lit(" - "), F.coalesce("address_zip", F.lit(""))).alias("location"),
        "facility_type", rnd(F.coalesce("trust_score", F.lit(0.0)), 3).alias("trust_score"),
        F.col("confidence.overall").alias("confidence_overall"),
        F.struct(
            ex.icu.present.alias("icu"), ex.icu.functional_status.alias("icu_functional"),
            ex.surgery.alias("surgery"), ex.emergency.is_24_7.alias("emergency_24_7"),
            ex.emergency.emergency_care.alias("emergency_status"), ex.staff.anesthesiologist.alias("anesthesiologist"),
            ex.staff.surgeon.alias("surgeon_type"), ex.dialysis.present.alias("dialysis"),
            F.slice(F.coalesce(ex.specialties_extracted, F.array().cast("array<string>")), 1, 10).alias("specialties"),
        ).alias("capabilities"),
        F.array(ex.surgery.source_text, ex.staff.source_text, ex.emergency.source_text).alias("key_source_texts"),
    )


def revalidate(hits: DataFrame, queries: DataFrame, gold: DataFrame) -> DataFrame:
    """Keep hits whose facility is still in Gold with trust >= the query's minimum; refresh attributes."""
    g = gold.select("facility_id", "name", "address_city", "address_state", "address_zip", "facility_type", "trust_score",
                    "extraction", "confidence")
    qm = queries.select("query_id", "min_trust_score")
    return (hits.join(g, "facility_id", "inner").join(qm, "query_id", "inner")
            .where(F.col("trust_score") >= F.col("min_trust_score")).drop("min_trust_score"))


def intent_satisfaction(cands: DataFrame) -> DataFrame:
    """Adds the query's ``intents`` that the facility's record satisfies (matched) and a phrase for each (evidence)."""
    ex = F.col("extraction")
    c = cands.withColumn("matched", F.filter("intents", lambda i: intent_matched(i, ex)))
    return c.withColumn("evidence", F.filter(F.transform("matched", lambda i: intent_evidence(i, ex)), lambda e: e != ""))


# Fixed values below: the sentences of a ranked result.
def fallback_rank(cands: DataFrame, queries: DataFrame, top_k_col: str = "top_k") -> DataFrame:
    """.55*clip(sim) + .30*trust + .15*coverage, reasoning text, warnings; top_k per query,
    ties kept in retrieval order."""
    q = queries.select("query_id", query_intents("query").alias("intents"), F.col(top_k_col).alias("_top_k"))
    c = intent_satisfaction(cands.join(q, "query_id", "inner"))
    n_int = F.size("intents")
    sim = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("similarity")))
    trust = rnd(F.coalesce("trust_score", F.lit(0.0)), 3)
    cov = F.when(n_int > 0, F.size("matched").cast("double") / n_int.cast("double")).otherwise(F.lit(0.5))
    score = F.lit(0.55) * sim + F.lit(0.30) * trust + F.lit(0.15) * cov
    name_or = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("facility"))
    reasoning = (
        F.when(F.size("evidence") > 0, F.concat(
            F.lit("Top match for your query — "), name_or, F.lit(" reports: "),
            F.array_join(F.slice("evidence", 1, 4), "; "), F.lit(". Trust score "), fmt2(trust),
            F.lit(" based on data completeness and consistency checks.")))
        .when(n_int > 0, F.concat(
            F.lit("Closest semantic match by description (similarity "), fmt2(sim),
            F.lit("); however, the facility's structured records do not explicitly confirm "),
            F.array_join("intents", ", "), F.lit(". Verify by phone before travel. Trust score "), fmt2(trust),
            F.lit(".")))
        .otherwise(F.concat(F.lit("Closest semantic match (similarity "), fmt2(sim), F.lit("). Trust score "),
                            fmt2(trust), F.lit(".")))
    )
    warnings = F.when(F.size("matched") == 0, F.transform("intents", lambda i: F.concat(F.lit("No clear evidence of "), i))) \
        .otherwise(F.array().cast("array<string>"))
    scored = c.select(
        "query_id", "facility_id", "retrieval_rank", "_top_k",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Unknown facility")).alias("facility_name"),
        score.alias("_score"),
        rnd(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4).alias("suitability_score"),
        reasoning.alias("reasoning"), F.col("matched").alias("matched_capabilities"), warnings.alias("warnings"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("_score"), F.asc("retrieval_rank"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("_top_k"))
            .drop("_score", "_top_k"))


def enrich(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Attach a facility_meta struct from Gold; unmatched rows kept without meta."""
    meta = gold.select(
        "facility_id",
        F.struct(
            "name", F.col("address_city").alias("city"), F.col("address_state").alias("state"),
            F.col("address_zip").alias("pin_code"), "latitude", "longitude", "facility_type", "operator_type",
            F.coalesce("trust_score", F.lit(0.0)).alias("trust_score"), trust_grade("trust_score").alias("trust_grade"),
            F.coalesce("trust_flags", F.array().cast("array<struct<flag_type:string,severity:string,"
                                                   "description:string,supporting_evidence:string>>")).alias("trust_flags"),
        ).alias("facility_meta"),
    )
    return ranked.join(meta, "facility_id", "left")


def model_rank(valid: DataFrame, queries: DataFrame, completer, calls_path: str, concurrency: int = 1) -> DataFrame:
    """The model ranker: one call per query over its candidates' summaries (X12, ``vector_top_k`` at most).

    Calls are written to ``calls_path`` before they are parsed. Returns query_id, content, call_error,
    prompt_tokens, completion_tokens, reply (X15, null on failure) and errors.
    """
    from caregrid.functions.parse import parse_ranking
    from caregrid.operators.inference import complete, ranking_messages

    spark = valid.sparkSession
    summary = candidate_summary(valid)
    fields = [c for c in summary.columns if c not in ("query_id", "retrieval_rank")]
    per = summary.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("retrieval_rank", F.struct(*fields).alias("c")))),
                                                      lambda x: x["c"]).alias("candidates"))
    req = per.join(queries.select("query_id", "query", "min_trust_score", "top_k"), "query_id")
    req = req.select("query_id", ranking_messages("query", "min_trust_score", "candidates", "top_k").alias("messages"))
    complete(req, "messages", completer, concurrency=concurrency).drop("messages").write.mode("overwrite").parquet(calls_path)
    return parse_ranking(spark.read.parquet(calls_path))


def query_facilities(queries: DataFrame, vt: DataFrame, gold: DataFrame, params: Params = DEFAULT,
                     mode: str = "prefilter", completer=None, calls_path: str | None = None,
                     concurrency: int = 1) -> tuple[DataFrame, DataFrame]:
    """V2 -> J5 -> ranker -> J6 for a batch of text queries.

    ``queries``: query_id, query, query_vec, state, city, facility_type, min_trust_score (null -> default), top_k.
    With a ``completer`` the model ranks each query's candidates; queries whose call or reply fails, and all
    queries without one, get the deterministic ranker (D14, ``fallback_mode``).
    Returns (ranked results, one response per query: interpretation, summary, note, filters, counters).
    """
    from caregrid.operators.vector import search
    from caregrid.session import stored

    qs = queries.withColumn("min_trust_score", F.coalesce("min_trust_score", F.lit(params.min_trust_for_reasoning)))
    hits = stored(search(qs, vt, top_k=params.vector_top_k, mode=mode, params=params), "hits")  # both frames read these
    valid = stored(revalidate(hits, qs, gold), "valid-hits")
    calls = None
    if completer is None:
        ranked = fallback_rank(valid, qs)
    else:
        calls = model_rank(valid, qs, completer, calls_path, concurrency)
        by_model = calls.where(F.col("reply").isNotNull()).select("query_id", F.inline("reply.ranked_results")).drop("citations")
        by_model = by_model.join(valid.select("query_id", "facility_id", "retrieval_rank"), ["query_id", "facility_id"], "left")
        rest = valid.join(calls.where(F.col("reply").isNotNull()).select("query_id"), "query_id", "left_anti")
        plain = fallback_rank(rest, qs)
        ranked = plain.unionByName(by_model.select(*plain.columns))
    ranked = enrich(ranked, gold)
    n_hits = hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("long").alias("candidates_retrieved"))
    n_valid = valid.groupBy("query_id").agg(F.count(F.lit(1)).cast("long").alias("candidates_after_filter"))
    top = ranked.groupBy("query_id").agg(F.max("suitability_score").alias("top_suitability"), F.count(F.lit(1)).cast("long").alias("n_ranked"))
    stats = (qs.select("query_id", "query", "min_trust_score", "state", "city", "facility_type")
             .join(n_hits, "query_id", "left").join(n_valid, "query_id", "left").join(top, "query_id", "left")
             .fillna(0, subset=["candidates_retrieved", "candidates_after_filter", "n_ranked"]))
    if calls is not None:
        stats = stats.join(calls.select("query_id", "reply", F.coalesce("call_error", F.array_join("errors", "; ")).alias("_error"),
                                        "prompt_tokens", "completion_tokens", F.col("content").alias("raw_reply")), "query_id", "left")
    else:
        stats = stats.select("*", F.lit(None).cast("struct<query_interpretation:string,recommendation_summary:string,uncertainty_note:string>")
                             .alias("reply"), F.lit("no model configured").alias("_error"), F.lit(0).cast("long").alias("prompt_tokens"),
                             F.lit(0).cast("long").alias("completion_tokens"), F.lit(None).cast("string").alias("raw_reply"))
    return ranked, _responses(stats)


# Fixed values below: the sentences of a response.
def _responses(stats: DataFrame) -> DataFrame:
    n, kept = F.col("n_ranked").cast("string"), F.col("candidates_after_filter").cast("string")
    none, out = F.col("candidates_retrieved") == 0, F.col("candidates_after_filter") == 0
    intents = F.array_join(query_intents("query"), ", ")
    plain = F.concat(F.lit("Heuristic ranker (LLM unavailable). Detected intents: "),
                     F.when(intents != "", intents).otherwise(F.lit("general search")), F.lit("."))
    summary = F.concat(F.lit("Top "), n, F.lit(" of "), kept, F.lit(
        " candidates ranked by vector similarity, structured trust score, and capability match. The LLM reasoning service is "
        "currently unreachable; results below are deterministic and grounded in the gold extraction records."))
    note = F.concat(F.lit("LLM error: "), F.col("_error"), F.lit(
        ". Reasoning fields are auto-generated from structured capabilities; please verify by phone before travel."))
    model = F.col("reply").isNotNull()
    return stats.select(
        "query_id", "query", F.when(none | out, F.lit("")).when(model, F.col("reply.query_interpretation")).otherwise(plain).alias("query_interpretation"),
        F.when(none, F.lit("No candidates met the filter and trust criteria."))
        .when(out, F.lit("Candidates were filtered out by the trust threshold."))
        .when(model, F.col("reply.recommendation_summary")).otherwise(summary).alias("recommendation_summary"),
        F.when(none, F.lit("")).when(out, F.concat(F.lit("Try lowering min_trust_score below "), F.col("min_trust_score").cast("string"), F.lit(".")))
        .when(model, F.col("reply.uncertainty_note")).otherwise(note).alias("uncertainty_note"),
        F.col("min_trust_score").alias("trust_threshold"), F.struct("state", "city", "facility_type").alias("filters"),
        (~model & ~none & ~out).alias("fallback_mode"), "candidates_retrieved", "candidates_after_filter", "top_suitability",
        F.struct(F.col("prompt_tokens").alias("prompt"), F.col("completion_tokens").alias("completion")).alias("tokens"), "raw_reply",
    )


def intents_of_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("intents", query_intents(text_col))


__all__ = ["intent_matched", "intent_evidence", "candidate_summary", "revalidate", "fallback_rank",
           "enrich", "query_facilities", "intents_of_text", "col"]
