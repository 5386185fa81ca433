"""Query catalog: one Spark query and (where SQL can express it) one oracle SQL per operator id.

Outputs are flat (arrays as joined text, structs as columns) and every double is
rounded the same way on both sides, so the driver can hash-compare them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caregrid.functions.core import confidence_band, rnd, trust_grade
from caregrid.operators import deserts as DZ
from caregrid.operators import trust as TR
from caregrid.operators.bronze import quality_report
from caregrid.plans import oracle as O
from caregrid.plans import pipeline as PL
from caregrid.sources.files import read_table as stored_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def q(chain, select: str) -> str:
    return O.with_ctes(*chain) + "\n" + select


# ---------------------------------------------------------------------------
# Loader (national registry)
# ---------------------------------------------------------------------------

@register("S7", q(O.CHAIN_REGISTRY, """SELECT src_ord, name, latitude, longitude, address_stateOrRegion,
  address_city, address_zipOrPostcode, category, functional_status, operatorTypeId, accessibility_note
FROM registry"""))
def s7(spark, sf):
    return PL.registry(spark, sf).select(
        "src_ord", "name", "latitude", "longitude", "address_stateOrRegion", "address_city",
        "address_zipOrPostcode", "category", "functional_status", "operatorTypeId", "accessibility_note")


@register("P9", q(O.CHAIN_REGISTRY, "SELECT src_ord, type_l AS raw_type, facilityTypeId FROM registry"))
def p9(spark, sf):
    from caregrid.sources.national import load_national
    from caregrid.sources.testdata import national_raw

    raw = national_raw(spark, sf)
    reg = load_national(raw.withColumn("raw_type", F.lower(F.trim(F.coalesce("type", F.lit(""))))),
                        keep=("src_key", "raw_type"))
    return reg.select("src_ord", "raw_type", "facilityTypeId")


@register("P10", q(O.CHAIN_REGISTRY, "SELECT src_ord, category, capability FROM registry"))
def p10(spark, sf):
    return PL.registry(spark, sf).select("src_ord", "category", "capability")


@register("P11", q(O.CHAIN_REGISTRY, "SELECT src_ord, description FROM registry"))
def p11(spark, sf):
    return PL.registry(spark, sf).select("src_ord", "description")


@register("P4", q(O.CHAIN_REGISTRY, """SELECT src_ord, labelled_text AS composite_text,
  CAST(length(labelled_text) AS BIGINT) AS composite_text_length FROM registry"""))
def p4(spark, sf):
    return PL.registry(spark, sf).select("src_ord", "composite_text", "composite_text_length")


@register("P2", q(O.CHAIN_REGISTRY, "SELECT src_ord, source_id FROM registry"))
def p2(spark, sf):
    return PL.registry(spark, sf).select("src_ord", "source_id")


@register("F1", q(O.CHAIN_REGISTRY, """SELECT count(*)::BIGINT AS kept_rows,
  count_if(name = '')::BIGINT AS kept_without_name,
  count_if(latitude IS NULL OR longitude IS NULL)::BIGINT AS kept_without_coordinates FROM registry"""))
def f1(spark, sf):
    return PL.registry(spark, sf).agg(
        F.count(F.lit(1)).cast("long").alias("kept_rows"),
        F.count_if(F.col("name") == "").cast("long").alias("kept_without_name"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).cast("long").alias("kept_without_coordinates"),
    )


# ---------------------------------------------------------------------------
# Bronze
# ---------------------------------------------------------------------------

@register("P1", q(O.CHAIN_BRONZE, "SELECT src_ord, facility_id FROM bronze"))
def p1(spark, sf):
    return PL.bronze(spark, sf).select("src_ord", "facility_id")


@register("P3", q(O.CHAIN_BRONZE, "SELECT facility_id, composite_text, composite_text_length FROM bronze"))
def p3(spark, sf):
    return PL.bronze(spark, sf).select("facility_id", "composite_text", "composite_text_length")


@register("P6", q(O.CHAIN_BRONZE, "SELECT facility_id, address_zipOrPostcode FROM bronze"))
def p6(spark, sf):
    return PL.bronze(spark, sf).select("facility_id", "address_zipOrPostcode")


@register("P8", q(O.CHAIN_BRONZE, "SELECT facility_id, facilityTypeId FROM bronze"))
def p8(spark, sf):
    return PL.bronze(spark, sf).select("facility_id", "facilityTypeId")


@register("A2", q(O.CHAIN_BRONZE, """SELECT facility_id, src_ord, name, address_city, address_stateOrRegion,
  latitude, longitude FROM bronze"""))
def a2(spark, sf):
    return PL.bronze(spark, sf).select(
        "facility_id", "src_ord", "name", "address_city", "address_stateOrRegion", "latitude", "longitude")


@register("A4", q(O.CHAIN_BRONZE, """SELECT count(*)::BIGINT AS total_rows,
  count_if(length(trim(coalesce(description, ''))) > 0)::BIGINT AS with_description,
  CAST(0 AS BIGINT) AS with_equipment,
  count_if(latitude IS NOT NULL AND longitude IS NOT NULL)::BIGINT AS with_lat_lon,
  count_if(length(trim(coalesce(address_zipOrPostcode, ''))) > 0)::BIGINT AS with_pin_code,
  count(DISTINCT facility_id)::BIGINT AS distinct_facility_ids
FROM bronze"""))
def a4(spark, sf):
    return quality_report(PL.bronze(spark, sf))


# ---------------------------------------------------------------------------
# Heuristic extraction, trust, confidence, Gold
# ---------------------------------------------------------------------------

@register("D1", q(O.CHAIN_GOLD, """SELECT facility_id, category, functional_status, icu_present, icu_functional,
  icu_beds, icu_neonatal, vent_present, vent_count, anest, surgeon, gp, n_spec_types, total_doctors,
  em_care, em_24_7, ambulance, trauma, sg_general, sg_append, sg_caes, sg_ortho, sg_cardiac,
  dial_present, dial_machines, array_to_string(specialties_list, ',') AS specialties, raw_text_used
FROM gold"""))
def d1(spark, sf):
    g = PL.gold(spark, sf)
    ex = F.col("extraction")
    return g.select(
        "facility_id", "category", "functional_status",
        ex.icu.present.alias("icu_present"), ex.icu.functional_status.alias("icu_functional"),
        ex.icu.bed_count.alias("icu_beds"), ex.icu.neonatal_icu.alias("icu_neonatal"),
        ex.ventilator.present.alias("vent_present"), ex.ventilator["count"].alias("vent_count"),
        ex.staff.anesthesiologist.alias("anest"), ex.staff.surgeon.alias("surgeon"),
        ex.staff.general_physician.alias("gp"), F.size(ex.staff.specialist_types).alias("n_spec_types"),
        ex.staff.total_doctor_count.alias("total_doctors"),
        ex.emergency.emergency_care.alias("em_care"), ex.emergency.is_24_7.alias("em_24_7"),
        ex.emergency.ambulance.alias("ambulance"), ex.emergency.trauma_capability.alias("trauma"),
        ex.surgery.general_surgery.alias("sg_general"), ex.surgery.appendectomy.alias("sg_append"),
        ex.surgery.caesarean.alias("sg_caes"), ex.surgery.orthopedic.alias("sg_ortho"),
        ex.surgery.cardiac.alias("sg_cardiac"), ex.dialysis.present.alias("dial_present"),
        ex.dialysis.machine_count.alias("dial_machines"),
        F.array_join(ex.specialties_extracted, ",").alias("specialties"), ex.raw_text_used.alias("raw_text_used"),
    )


@register("D2", q(O.CHAIN_GOLD, """SELECT facility_id, flag_types, flag_evidence, CAST(n_flags AS INTEGER) AS n_flags
FROM gold"""))
def d2(spark, sf):
    g = PL.gold(spark, sf)
    return g.select(
        "facility_id", TR.flags_text("trust_flags").alias("flag_types"),
        F.array_join(F.transform("trust_flags", lambda x: x["supporting_evidence"]), " ; ").alias("flag_evidence"),
        F.size("trust_flags").alias("n_flags"),
    )


@register("D3", q(O.CHAIN_GOLD, """SELECT facility_id, conf_completeness AS completeness,
  conf_consistency AS consistency, conf_reliability AS reliability, conf_overall AS overall,
  conf_low AS confidence_interval_low, conf_high AS confidence_interval_high FROM gold"""))
def d3(spark, sf):
    g = PL.gold(spark, sf)
    return g.select("facility_id", *[F.col("confidence")[c].alias(c) for c in (
        "completeness", "consistency", "reliability", "overall",
        "confidence_interval_low", "confidence_interval_high")])


@register("D5", q(O.CHAIN_GOLD, """SELECT facility_id, name, address_city, address_state, address_zip,
  latitude, longitude, facility_type, operator_type, category, functional_status, accessibility_note,
  trust_score, 0 AS correction_iterations, 'heuristic-1.0' AS extraction_version FROM gold"""))
def d5(spark, sf):
    g = PL.gold(spark, sf)
    return g.select(
        "facility_id", "name", "address_city", "address_state", "address_zip", "latitude", "longitude",
        "facility_type", "operator_type", "category", "functional_status", "accessibility_note",
        "trust_score", "correction_iterations", "extraction_version")


@register("X13", q(O.CHAIN_GOLD, "SELECT facility_id, embedding_text FROM gold"))
def x13(spark, sf):
    return PL.gold(spark, sf).select("facility_id", "embedding_text")


@register("D6", q(O.CHAIN_GOLD, """SELECT facility_id, trust_score,
  CASE WHEN trust_score >= 0.85 THEN 'A' WHEN trust_score >= 0.70 THEN 'B' WHEN trust_score >= 0.55 THEN 'C'
       WHEN trust_score >= 0.40 THEN 'D' ELSE 'F' END AS trust_grade FROM gold"""))
def d6(spark, sf):
    return PL.gold(spark, sf).select("facility_id", "trust_score", trust_grade("trust_score").alias("trust_grade"))


@register("D20", q(O.CHAIN_GOLD, """SELECT facility_id, conf_overall AS overall,
  CASE WHEN conf_overall >= 0.80 THEN 'high' WHEN conf_overall >= 0.60 THEN 'moderate'
       WHEN conf_overall >= 0.40 THEN 'low' ELSE 'very low' END AS confidence_band FROM gold"""))
def d20(spark, sf):
    g = PL.gold(spark, sf)
    return g.select("facility_id", F.col("confidence.overall").alias("overall"),
                    confidence_band("confidence.overall").alias("confidence_band"))


@register("X16", q(O.CHAIN_GOLD, """SELECT facility_id,
  (icu_present IN ('confirmed','claimed') AND icu_functional <> 'non_functional') AS working_icu FROM gold"""))
def x16(spark, sf):
    return PL.gold(spark, sf).select("facility_id", TR.working_icu("extraction").alias("working_icu"))


@register("A5", q(O.CHAIN_GOLD, f"""SELECT count(*)::BIGINT AS gold_rows, {O.rd('avg(trust_score)', 6)} AS avg_trust_score,
  {O.rd('avg(CAST(trust_score >= 0.7 AS DOUBLE))', 6)} AS pct_trust_above_0_7 FROM gold"""))
def a5(spark, sf):
    from caregrid.operators.gold import gold_summary

    s = gold_summary(PL.gold(spark, sf))
    return s.select("gold_rows", rnd("avg_trust_score", 6).alias("avg_trust_score"),
                    rnd("pct_trust_above_0_7", 6).alias("pct_trust_above_0_7"))


# ---------------------------------------------------------------------------
# Deserts
# ---------------------------------------------------------------------------

DESERT_COLS_SQL = f"""pin_code, state, facility_count, {O.rd('avg_trust_score', 6)} AS avg_trust_score,
  {O.rd('icu_coverage', 6)} AS icu_coverage, {O.rd('dialysis_coverage', 6)} AS dialysis_coverage,
  {O.rd('emergency_coverage', 6)} AS emergency_coverage, {O.rd('surgery_coverage', 6)} AS surgery_coverage,
  {O.rd('centroid_lat', 6)} AS centroid_lat, {O.rd('centroid_lon', 6)} AS centroid_lon"""


def _desert_cols(d: DataFrame) -> list:
    return ["pin_code", "state", "facility_count"] + [
        rnd(c, 6).alias(c) for c in ("avg_trust_score", "icu_coverage", "dialysis_coverage",
                                     "emergency_coverage", "surgery_coverage", "centroid_lat", "centroid_lon")]


@register("A1", q(O.CHAIN_DESERTS, f"SELECT {DESERT_COLS_SQL} FROM deserts"))
def a1(spark, sf):
    return DZ.area_coverage(PL.gold(spark, sf)).select(*_desert_cols(None))


@register("D16", q(O.CHAIN_DESERTS, "SELECT pin_code, state, desert_risk_score, desert_risk_score >= 0.70 AS is_high_risk FROM deserts"))
def d16(spark, sf):
    return PL.desert_table(spark, sf).select("pin_code", "state", "desert_risk_score", "is_high_risk")


@register("D17", q(O.CHAIN_DESERTS, "SELECT pin_code, state, desert_categories FROM deserts"))
def d17(spark, sf):
    return PL.desert_table(spark, sf).select(
        "pin_code", "state", F.array_join("desert_categories", ",").alias("desert_categories"))


@register("A7", q(O.CHAIN_DESERTS, f"""SELECT count(*)::BIGINT AS desert_pin_codes,
  count_if(desert_risk_score >= 0.70)::BIGINT AS high_risk_pin_codes,
  {O.rd('avg(desert_risk_score)', 6)} AS avg_desert_risk FROM deserts"""))
def a7(spark, sf):
    s = DZ.desert_summary(PL.desert_table(spark, sf))
    return s.select("desert_pin_codes", "high_risk_pin_codes", rnd("avg_desert_risk", 6).alias("avg_desert_risk"))


@register("A8", q(O.CHAIN_DESERTS, f"""SELECT state, count(*)::BIGINT AS areas,
  count_if(desert_risk_score >= 0.70)::BIGINT AS high_risk_areas, {O.rd('avg(desert_risk_score)', 6)} AS avg_risk
FROM deserts GROUP BY state ORDER BY avg_risk DESC, state NULLS FIRST LIMIT 10"""))
def a8(spark, sf):
    r = DZ.state_rollup(PL.desert_table(spark, sf), top_n=None)
    r = r.select("state", "areas", "high_risk_areas", rnd("avg_risk", 6).alias("avg_risk"))
    return r.orderBy(F.desc("avg_risk"), F.asc_nulls_first("state")).limit(10)


@register("W4", q(O.CHAIN_DESERTS, f"""SELECT pin_code, state, desert_risk_score FROM deserts
ORDER BY desert_risk_score DESC, pin_code NULLS FIRST, state NULLS FIRST LIMIT 25"""))
def w4(spark, sf):
    d = PL.desert_table(spark, sf)
    return d.orderBy(F.desc("desert_risk_score"), F.asc_nulls_first("pin_code"), F.asc_nulls_first("state")) \
        .limit(25).select("pin_code", "state", "desert_risk_score")


@register("D18", q(O.CHAIN_DESERTS, f"""SELECT pin_code, state, facility_count, desert_risk_score,
  desert_risk_score >= 0.70 AS is_high_risk, desert_categories,
  {O.rd('centroid_lat', 6)} AS centroid_lat, {O.rd('centroid_lon', 6)} AS centroid_lon,
  {O.rd('icu_coverage', 6)} AS coverage_icu, {O.rd('surgery_coverage', 6)} AS coverage_surgery
FROM deserts WHERE lower(state) = 'asia' AND contains(desert_categories, 'DIALYSIS_DESERT')
ORDER BY desert_risk_score DESC, pin_code NULLS FIRST, state NULLS FIRST LIMIT 100"""))
def d18(spark, sf):
    m = DZ.desert_map(PL.desert_table(spark, sf), state="Asia", desert_type="DIALYSIS_DESERT", limit=100)
    return m.select("pin_code", "state", "facility_count", "desert_risk_score", "is_high_risk",
                    F.array_join("desert_categories", ",").alias("desert_categories"),
                    rnd("centroid_lat", 6).alias("centroid_lat"), rnd("centroid_lon", 6).alias("centroid_lon"),
                    rnd("coverage.icu", 6).alias("coverage_icu"), rnd("coverage.surgery", 6).alias("coverage_surgery"))


@register("A13", q(O.CHAIN_DESERTS, f"""SELECT count(*)::BIGINT AS total_regions,
  count_if(is_high_risk)::BIGINT AS high_risk_regions,
  CASE WHEN count(*) > 0 THEN {O.rd('CAST(count_if(is_high_risk) AS DOUBLE) / CAST(count(*) AS DOUBLE) * CAST(100.0 AS DOUBLE)', 1)}
       ELSE CAST(0.0 AS DOUBLE) END AS high_risk_percentage
FROM (SELECT *, desert_risk_score >= 0.70 AS is_high_risk FROM deserts
      ORDER BY desert_risk_score DESC, pin_code NULLS FIRST, state NULLS FIRST LIMIT 50)"""))
def a13(spark, sf):
    m = DZ.desert_map(PL.desert_table(spark, sf), limit=50)
    return DZ.desert_map_summary(m)


# ---------------------------------------------------------------------------
# Geo: nearest facilities (grid join vs brute-force oracle)
# ---------------------------------------------------------------------------

def _geo_inputs(spark, sf):
    from caregrid.operators import geo as GEO
    from caregrid.sources.testdata import nearest_requests

    g = PL.gold(spark, sf)
    return GEO, nearest_requests(spark, sf), g


@register("D8", q(O.CHAIN_GEO, """SELECT facility_id, cap_emergency, cap_icu, cap_maternity, cap_surgery,
  cap_dialysis, cap_pediatric, cap_general FROM cand"""))
def d8(spark, sf):
    GEO, _, g = _geo_inputs(spark, sf)
    c = GEO.facility_candidates(g)
    return c.select("facility_id", *[F.col("cap_scores")[n].alias(f"cap_{n}") for n in (
        "emergency", "icu", "maternity", "surgery", "dialysis", "pediatric", "general")])


@register("D10", q(O.CHAIN_GEO, "SELECT facility_id, matched_capabilities FROM cand"))
def d10(spark, sf):
    GEO, _, g = _geo_inputs(spark, sf)
    return GEO.facility_candidates(g).select(
        "facility_id", F.array_join("matched_capabilities", "; ").alias("matched_capabilities"))


_PAIRS_SQL = f"""
allpairs AS (
  SELECT r.request_id, c.facility_id, r.radius_km,
    {O.rd(O.hav_sql('r.lat', 'r.lon', 'c.latitude', 'c.longitude'), 2)} AS distance_km
  FROM req r, cand c
)"""


@register("J10", q(O.CHAIN_GEO + (_PAIRS_SQL,),
                   "SELECT request_id, facility_id, distance_km FROM allpairs WHERE distance_km <= radius_km"))
def j10(spark, sf):
    GEO, req, g = _geo_inputs(spark, sf)
    pairs = GEO.candidate_pairs(req, GEO.facility_candidates(g))
    return pairs.select("request_id", "facility_id", "distance_km")


@register("D7", q(O.CHAIN_GEO + (_PAIRS_SQL,), """SELECT request_id, count(*)::BIGINT AS n_in_radius,
  min(distance_km) AS nearest_km, max(distance_km) AS farthest_km
FROM allpairs WHERE distance_km <= radius_km GROUP BY request_id"""))
def d7(spark, sf):
    from caregrid.operators import facility_index as FI

    GEO, req, g = _geo_inputs(spark, sf)
    return FI.radius_summary(req, GEO.facility_candidates(g)).select(
        "request_id", F.col("n").alias("n_in_radius"), "nearest_km", "farthest_km")


@register("F5", q(O.CHAIN_GEO + (O.ranked_sql("req", "rk"),),
                  "SELECT request_id, count(*)::BIGINT AS n_candidates FROM rk_scored GROUP BY request_id"))
def f5(spark, sf):
    from caregrid.operators import facility_index as FI

    GEO, req, g = _geo_inputs(spark, sf)
    return FI.count_eligible(GEO.check_requests(req)[0], GEO.facility_candidates(g)).select("request_id", F.col("n").alias("n_candidates"))


@register("D9", q(O.CHAIN_GEO + (O.ranked_sql("req", "rk"),),
                  "SELECT request_id, facility_id, distance_km, cap_score, composite_score FROM rk_scored"))
def d9(spark, sf):
    GEO, req, g = _geo_inputs(spark, sf)
    pairs = GEO.eligible_pairs(GEO.check_requests(req)[0], GEO.facility_candidates(g))
    return GEO.score_pairs(pairs).select("request_id", "facility_id", "distance_km", "cap_score", "composite_score")


_D11_COLS = """request_id, rank, facility_id, facility_name, composite_score, distance_km, estimated_travel_min,
  trust_score, trust_grade, cap_score, matched_capabilities"""


def _d11_select(df):
    return df.select("request_id", "rank", "facility_id", "facility_name", "composite_score", "distance_km",
                     "estimated_travel_min", "trust_score", "trust_grade", "cap_score",
                     F.array_join("matched_capabilities", "; ").alias("matched_capabilities"))


@register("D11", q(O.CHAIN_GEO + (O.ranked_sql("req", "rk"),), f"SELECT {_D11_COLS} FROM rk"))
def d11(spark, sf):
    GEO, req, g = _geo_inputs(spark, sf)
    return _d11_select(GEO.rank_nearest(req, g))


@register("D11P", q(O.CHAIN_GEO + ("wide AS (SELECT * REPLACE (radius_km * 10 AS radius_km) FROM req)", O.ranked_sql("wide", "rk")), f"SELECT {_D11_COLS} FROM rk"))
def d11_pruned(spark, sf):
    """D11 at ten times the radius, with upper bounds of the scores by cell."""
    from caregrid.operators import facility_index as FI

    _, req, g = _geo_inputs(spark, sf)
    return _d11_select(FI.nearest_pruned(req.withColumn("radius_km", F.col("radius_km") * 10), g))


@register("D11N", q(O.CHAIN_GEO + (O.ranked_sql("req", "rk"), _PAIRS_SQL), """SELECT request_id, rank, facility_id,
  (SELECT count(*) FROM allpairs p WHERE p.request_id = rk.request_id AND p.distance_km <= p.radius_km)::BIGINT AS n_in_radius FROM rk"""))
def d11_counted(spark, sf):
    """D11 with the number of facilities within the radius, counted by cells."""
    from caregrid.operators import facility_index as FI

    _, req, g = _geo_inputs(spark, sf)
    return FI.rank_nearest_counted(req, g).select("request_id", "rank", "facility_id", "n_in_radius")


@register("W1", q(O.CHAIN_GEO + (O.ranked_sql("req", "rk"),), "SELECT request_id, rank, facility_id FROM rk"))
def w1(spark, sf):
    GEO, req, g = _geo_inputs(spark, sf)
    return GEO.rank_nearest(req, g).select("request_id", "rank", "facility_id")


_RETRY_SQL = f"""
missing AS (SELECT * FROM req WHERE request_id NOT IN (SELECT request_id FROM rk)),
req2 AS (
  SELECT request_id, lat, lon, 'general' AS need_type, top_k, radius_km * {O.dbl(2)} AS radius_km,
    {O.dbl(0.0)} AS min_trust_score, false AS functional_only
  FROM missing
)"""


@register("D12", q(O.CHAIN_GEO + (O.ranked_sql("req", "rk"), _RETRY_SQL, O.ranked_sql("req2", "rk2")), f"""
SELECT request_id, rank, facility_id, composite_score, distance_km, fallback_used, message,
  CAST(count(facility_id) OVER (PARTITION BY request_id) AS INTEGER) AS total_found FROM (
  SELECT request_id, rank, facility_id, composite_score, distance_km, false AS fallback_used, '' AS message FROM rk
  UNION ALL
  SELECT m.request_id, k.rank, k.facility_id, k.composite_score, k.distance_km, true AS fallback_used,
    'No ' || m.need_type || ' specialists found within ' || printf('%.0f', m.radius_km)
      || ' km. Showing nearest general facilities instead.' AS message
  FROM missing m LEFT JOIN rk2 k ON k.request_id = m.request_id
)"""))
def d12(spark, sf):
    GEO, req, g = _geo_inputs(spark, sf)
    out = GEO.nearest_with_fallback(req, g)
    return out.select("request_id", "rank", "facility_id", "composite_score", "distance_km",
                      "fallback_used", "message", "total_found")


# ---------------------------------------------------------------------------
# Vector search
# ---------------------------------------------------------------------------

def _vector_inputs(spark, sf):
    from caregrid.operators import vector as VX
    from caregrid.sources.testdata import read_table, vector_queries

    vt = VX.vector_table(PL.gold(spark, sf), read_table(spark, sf, "embeddings"), dim=64)
    return VX, vector_queries(spark, sf), vt


@register("V3", q(O.CHAIN_VECTOR, """SELECT facility_id, CAST(len(emb) AS INTEGER) AS embedding_dim,
  {0} AS embedding_norm FROM vt""".format(O.rd("sqrt(list_dot_product(emb, emb))", 6))))
def v3(spark, sf):
    VX, _, vt = _vector_inputs(spark, sf)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vt.select("facility_id", "embedding_dim", rnd(norm, 6).alias("embedding_norm"))


@register("V2", q(O.CHAIN_VECTOR + (O.prefilter_sql(5),), "SELECT * FROM hits"))
def v2(spark, sf):
    VX, qs, vt = _vector_inputs(spark, sf)
    return VX.search(qs, vt, top_k=5)


@register("V2X", q(O.CHAIN_VECTOR + (O.prefilter_sql(5),), "SELECT * FROM hits"))
def v2_index(spark, sf):
    """V2 over the stored metric index with quantised vectors."""
    from caregrid.operators import vector_index as VI

    VX, qs, vt = _vector_inputs(spark, sf)
    path = PL.table_path(spark, sf, f"vector_index_{uuid.uuid4().hex}")
    VI.build(vt, path)
    return VI.search(qs, path, 5)


@register("W3", q(O.CHAIN_VECTOR + (O.postfilter_sql(5),), "SELECT * FROM hits"))
def w3(spark, sf):
    """Over-fetch 4 k by similarity, filter, keep k: may give fewer than k."""
    VX, qs, vt = _vector_inputs(spark, sf)
    return VX.search(qs, vt, top_k=5, mode="postfilter")


@register("J11", q(O.CHAIN_VECTOR, """SELECT query_id, facility_id, similarity, CAST(sim_rank AS INTEGER) AS retrieval_rank
FROM sims_ranked WHERE sim_rank <= least((SELECT count(*) FROM vt), 20)"""))
def j11(spark, sf):
    VX, qs, vt = _vector_inputs(spark, sf)
    unfiltered = qs.select("query_id", "query_vec", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("state", "string"), ("city", "string"), ("facility_type", "string"), ("min_trust_score", "double"))])
    return VX.search(unfiltered, vt, top_k=20)


@register("V2B", q(O.CHAIN_VECTOR + (O.prefilter_sql(5),), "SELECT * FROM hits"))
def v2_blocked(spark, sf):
    """V2 through the blocked cogroup path (the plan used above the broadcast bound)."""
    VX, qs, vt = _vector_inputs(spark, sf)
    return VX.search(qs, vt, top_k=5, force_blocked=True)


# ---------------------------------------------------------------------------
# Intents, ranking, query pipeline
# ---------------------------------------------------------------------------

@register("X10", f"SELECT doc_id, array_to_string({O.intents_sql('text')}, ',') AS intents FROM documents")
def x10(spark, sf):
    from caregrid.functions.text import query_intents
    from caregrid.sources.testdata import read_table

    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(query_intents("text"), ",").alias("intents"))


@register("X17", """SELECT conv_id, turn,
  CASE WHEN contains(lower(coalesce(text, '')), 'icu') THEN 'icu'
       WHEN contains(lower(coalesce(text, '')), 'maternity') OR contains(lower(coalesce(text, '')), 'baby')
            OR contains(lower(coalesce(text, '')), 'birth') THEN 'maternity'
       WHEN contains(lower(coalesce(text, '')), 'surgery') OR contains(lower(coalesce(text, '')), 'operation') THEN 'surgery'
       WHEN contains(lower(coalesce(text, '')), 'dialysis') OR contains(lower(coalesce(text, '')), 'kidney') THEN 'dialysis'
       WHEN contains(lower(coalesce(text, '')), 'emergency') OR contains(lower(coalesce(text, '')), 'help') THEN 'emergency'
  END AS need_type
FROM conversations""")
def x17(spark, sf):
    from caregrid.functions.text import need_from_text
    from caregrid.sources.testdata import read_table

    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", need_from_text("text").alias("need_type"))


def _ranked(spark, sf):
    from caregrid.operators import rank as RK

    VX, qs, vt = _vector_inputs(spark, sf)
    return RK.query_facilities(qs, vt, PL.gold(spark, sf))


_RANK_COLS = """query_id, rank, facility_id, facility_name, suitability_score, reasoning,
  matched_capabilities, warnings"""


def _rank_select(df):
    return df.select("query_id", "rank", "facility_id", "facility_name", "suitability_score", "reasoning",
                     F.array_join("matched_capabilities", ",").alias("matched_capabilities"),
                     F.array_join("warnings", "; ").alias("warnings"))


@register("D14", q(O.CHAIN_RANK, f"SELECT {_RANK_COLS} FROM ranked"))
def d14(spark, sf):
    return _rank_select(_ranked(spark, sf)[0])


@register("D13", q(O.CHAIN_RANK, "SELECT query_id, facility_id, matched_capabilities, evidence_text AS evidence FROM ranked_all"))
def d13(spark, sf):
    from caregrid.functions.text import query_intents
    from caregrid.operators import rank as RK

    VX, qs, vt = _vector_inputs(spark, sf)
    qs = qs.withColumn("min_trust_score", F.coalesce("min_trust_score", F.lit(0.4)))
    valid = RK.revalidate(VX.search(qs, vt, top_k=20), qs, PL.gold(spark, sf))
    out = RK.intent_satisfaction(valid.join(qs.select("query_id", query_intents("query").alias("intents")), "query_id"))
    return out.select("query_id", "facility_id", F.array_join("matched", ",").alias("matched_capabilities"),
                      F.array_join("evidence", "; ").alias("evidence"))


@register("J5", q(O.CHAIN_RANK, "SELECT query_id, facility_id, retrieval_rank FROM rcands"))
def j5(spark, sf):
    from caregrid.operators import rank as RK

    VX, qs, vt = _vector_inputs(spark, sf)
    qs = qs.withColumn("min_trust_score", F.coalesce("min_trust_score", F.lit(0.4)))
    hits = VX.search(qs, vt, top_k=20)
    return RK.revalidate(hits, qs, PL.gold(spark, sf)).select("query_id", "facility_id", "retrieval_rank")


@register("D15", q(O.CHAIN_RANK, f"""SELECT {_RANK_COLS}, address_city AS meta_city, address_state AS meta_state,
  CASE WHEN trust_score >= 0.85 THEN 'A' WHEN trust_score >= 0.70 THEN 'B' WHEN trust_score >= 0.55 THEN 'C'
       WHEN trust_score >= 0.40 THEN 'D' ELSE 'F' END AS meta_trust_grade FROM ranked"""))
def d15(spark, sf):
    r = _ranked(spark, sf)[0]
    m = F.col("facility_meta")
    return r.select("query_id", "rank", "facility_id", "facility_name", "suitability_score", "reasoning",
                    F.array_join("matched_capabilities", ",").alias("matched_capabilities"),
                    F.array_join("warnings", "; ").alias("warnings"), m["city"].alias("meta_city"),
                    m["state"].alias("meta_state"), m["trust_grade"].alias("meta_trust_grade"))


_RESPONSE_SQL = f"""
resp AS (
  SELECT vq.query_id, vq.query, coalesce(vq.min_trust_score, {O.dbl(0.4)}) AS trust_threshold, coalesce(h.n, 0) AS n_hits, coalesce(c.n, 0) AS n_valid,
    coalesce(r.n, 0) AS n_ranked, array_to_string({O.intents_sql('vq.query')}, ', ') AS tags
  FROM vq LEFT JOIN (SELECT query_id, count(*) AS n FROM hits GROUP BY 1) h ON vq.query_id = h.query_id
  LEFT JOIN (SELECT query_id, count(*) AS n FROM rcands GROUP BY 1) c ON vq.query_id = c.query_id
  LEFT JOIN (SELECT query_id, count(*) AS n FROM ranked GROUP BY 1) r ON vq.query_id = r.query_id
)"""


@register("D15R", q(O.CHAIN_RANK + (_RESPONSE_SQL,), """SELECT query_id, trust_threshold, n_hits > 0 AND n_valid > 0 AS fallback_mode,
  CASE WHEN n_hits = 0 OR n_valid = 0 THEN '' ELSE 'Heuristic ranker (LLM unavailable). Detected intents: '
    || coalesce(nullif(tags, ''), 'general search') || '.' END AS query_interpretation,
  CASE WHEN n_hits = 0 THEN 'No candidates met the filter and trust criteria.' WHEN n_valid = 0 THEN 'Candidates were filtered out by the trust threshold.'
    ELSE 'Top ' || n_ranked || ' of ' || n_valid || ' candidates ranked by vector similarity, structured trust score, and capability match. '
      || 'The LLM reasoning service is currently unreachable; results below are deterministic and grounded in the gold extraction records.' END AS recommendation_summary,
  CASE WHEN n_hits = 0 THEN '' WHEN n_valid = 0 THEN 'Try lowering min_trust_score below ' || trust_threshold || '.'
    ELSE 'LLM error: no model configured. Reasoning fields are auto-generated from structured capabilities; please verify by phone before travel.' END AS uncertainty_note
FROM resp"""))
def d15_response(spark, sf):
    """The per-query response of D15."""
    return _ranked(spark, sf)[1].select("query_id", "trust_threshold", "fallback_mode", "query_interpretation",
                                        "recommendation_summary", "uncertainty_note")


@register("D15M", q(O.CHAIN_RANK, """SELECT query_id, facility_id, facility_name, CAST(row_number() OVER (PARTITION BY query_id ORDER BY trust DESC, facility_id) AS INTEGER) AS rank,
  trust AS suitability_score, false AS fallback_mode FROM (SELECT *, """ + O.rd("coalesce(trust_score, 0.0)", 3) + """ AS trust FROM ranked_all)"""))
def d15_model(spark, sf):
    """D15 through the model ranker with the offline stand-in, which orders by trust."""
    from caregrid.operators import rank as RK
    from caregrid.operators.inference import OfflineCompleter

    VX, qs, vt = _vector_inputs(spark, sf)
    ranked, resp = RK.query_facilities(qs, vt, PL.gold(spark, sf), completer=OfflineCompleter(),
                                       calls_path=PL.table_path(spark, sf, "rank_calls"))
    return ranked.join(resp.select("query_id", "fallback_mode"), "query_id").select(
        "query_id", "facility_id", "facility_name", "rank", "suitability_score", "fallback_mode")


@register("J6", q(O.CHAIN_RANK, """SELECT query_id, facility_id, address_city AS city, address_state AS state,
  trust_score FROM ranked"""))
def j6(spark, sf):
    r = _ranked(spark, sf)[0]
    return r.select("query_id", "facility_id", F.col("facility_meta.city").alias("city"),
                    F.col("facility_meta.state").alias("state"), F.col("facility_meta.trust_score").alias("trust_score"))


@register("A17", q(O.CHAIN_RANK, """SELECT vq.query_id, coalesce(h.n, 0)::BIGINT AS candidates_retrieved,
  coalesce(c.n, 0)::BIGINT AS candidates_after_filter, r.top AS top_suitability
FROM vq LEFT JOIN (SELECT query_id, count(*) AS n FROM hits GROUP BY 1) h ON vq.query_id = h.query_id
LEFT JOIN (SELECT query_id, count(*) AS n FROM rcands GROUP BY 1) c ON vq.query_id = c.query_id
LEFT JOIN (SELECT query_id, max(suitability_score) AS top FROM ranked GROUP BY 1) r ON vq.query_id = r.query_id"""))
def a17(spark, sf):
    stats = _ranked(spark, sf)[1]
    return stats.select("query_id", "candidates_retrieved", "candidates_after_filter", "top_suitability")


# ---------------------------------------------------------------------------
# Model replies: X1-X6
# ---------------------------------------------------------------------------

def _parsed_replies(spark, sf):
    from caregrid.functions import parse as PR
    from caregrid.sources.testdata import model_replies

    return PR.parse_replies(model_replies(spark, sf), "raw_response", "facility_id")


def _ok_only(col_expr, name):
    return F.when(F.col("extraction").isNotNull(), col_expr).alias(name)


@register("X1", q((O.REPLIES,), "SELECT event_id, body, coalesce(CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' END, false) AS is_object FROM parsed"))
def x1(spark, sf):
    p = _parsed_replies(spark, sf)
    v = F.try_parse_json("body")
    return p.select("event_id", "body", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"))


@register("X3", q((O.REPLIES,), "SELECT event_id, facility_id, error IS NULL AS ok, error FROM validated"))
def x3(spark, sf):
    p = _parsed_replies(spark, sf)
    return p.select("event_id", "facility_id", F.col("extraction").isNotNull().alias("ok"),
                    F.try_element_at("errors", F.lit(1)).alias("error"))


@register("X2", q((O.REPLIES,), """SELECT event_id, facility_id,
  CASE WHEN error IS NULL THEN icu_present END AS icu_present,
  CASE WHEN error IS NULL THEN dialysis_present END AS dialysis_present,
  CASE WHEN error IS NULL THEN is_24_7 END AS is_24_7
FROM validated"""))
def x2(spark, sf):
    p = _parsed_replies(spark, sf)
    ex = F.col("extraction")
    return p.select("event_id", "facility_id", _ok_only(ex.icu.present, "icu_present"),
                    _ok_only(ex.dialysis.present, "dialysis_present"), _ok_only(ex.emergency.is_24_7, "is_24_7"))


@register("X4", q((O.REPLIES,), """SELECT event_id,
  CASE WHEN error IS NULL THEN icu_beds END AS icu_beds,
  CASE WHEN error IS NULL THEN total_doctors END AS total_doctors,
  CASE WHEN error IS NULL THEN dialysis_machines END AS dialysis_machines,
  CASE WHEN error IS NULL THEN vent_count END AS vent_count
FROM validated"""))
def x4(spark, sf):
    p = _parsed_replies(spark, sf)
    ex = F.col("extraction")
    return p.select("event_id", _ok_only(ex.icu.bed_count, "icu_beds"),
                    _ok_only(ex.staff.total_doctor_count, "total_doctors"),
                    _ok_only(ex.dialysis.machine_count, "dialysis_machines"),
                    _ok_only(ex.ventilator["count"], "vent_count"))


@register("X5", q((O.REPLIES,), """SELECT event_id,
  CASE WHEN error IS NULL THEN array_to_string(specialist_types, '|') END AS specialist_types,
  CASE WHEN error IS NULL THEN CAST(len(specialist_types) AS INTEGER) END AS n_specialist_types
FROM validated"""))
def x5(spark, sf):
    p = _parsed_replies(spark, sf)
    st = F.col("extraction.staff.specialist_types")
    return p.select("event_id", _ok_only(F.array_join(st, "|"), "specialist_types"),
                    _ok_only(F.size(st), "n_specialist_types"))


@register("X6", q((O.REPLIES,), """SELECT event_id,
  CASE WHEN error IS NULL THEN array_to_string(specialties, '|') END AS specialties FROM validated"""))
def x6(spark, sf):
    p = _parsed_replies(spark, sf)
    return p.select("event_id", _ok_only(F.array_join("extraction.specialties_extracted", "|"), "specialties"))


# ---------------------------------------------------------------------------
# Reports over Gold and deserts
# ---------------------------------------------------------------------------

@register("A6", q(O.CHAIN_GOLD, f"""SELECT count(*)::BIGINT AS rows, {O.rd('avg(trust_score)', 3)} AS avg_trust,
  {O.rd('avg(conf_overall)', 3)} AS avg_conf, count_if(trust_score < 0.65)::BIGINT AS low_trust FROM gold"""))
def a6(spark, sf):
    from caregrid.operators import reports as RP

    return RP.smoke_summary(PL.gold(spark, sf))


@register("W5", q(O.CHAIN_GOLD, """SELECT facility_id, name, address_city, facility_type,
  total_doctors AS doctors, trust_score, conf_overall AS confidence_overall
FROM gold ORDER BY trust_score DESC, facility_id LIMIT 10"""))
def w5(spark, sf):
    from caregrid.operators import reports as RP

    return RP.top_by_trust(PL.gold(spark, sf), 10)


@register("W6", q(O.CHAIN_DESERTS, f"""SELECT pin_code, state, facility_count, {O.rd('avg_trust_score', 6)} AS avg_trust_score,
  {O.rd('icu_coverage', 6)} AS icu_coverage, {O.rd('emergency_coverage', 6)} AS emergency_coverage,
  {O.rd('dialysis_coverage', 6)} AS dialysis_coverage, {O.rd('surgery_coverage', 6)} AS surgery_coverage,
  desert_risk_score, desert_risk_score >= 0.70 AS is_high_risk, desert_categories
FROM deserts ORDER BY desert_risk_score DESC, pin_code NULLS FIRST, state NULLS FIRST LIMIT 15"""))
def w6(spark, sf):
    from caregrid.operators import reports as RP

    return RP.worst_areas(PL.desert_table(spark, sf), 15)


@register("A9", q(O.CHAIN_BRONZE, """SELECT address_stateOrRegion AS state, count(*)::BIGINT AS n FROM bronze
GROUP BY 1 ORDER BY n DESC, state NULLS FIRST LIMIT 20"""))
def a9(spark, sf):
    from caregrid.operators import reports as RP

    return RP.state_distribution(PL.bronze(spark, sf), 20)


@register("A10", q(O.CHAIN_REGISTRY, """SELECT 'facility_type' AS dimension, facilityTypeId AS value, count(*)::BIGINT AS n FROM registry GROUP BY 2
UNION ALL SELECT 'functional_status', functional_status, count(*)::BIGINT FROM registry GROUP BY 2
UNION ALL SELECT 'category', category, count(*)::BIGINT FROM registry GROUP BY 2
UNION ALL SELECT 'distinct_states', NULL, count(DISTINCT address_stateOrRegion)::BIGINT FROM registry
UNION ALL SELECT 'with_coordinates', NULL, count_if(latitude IS NOT NULL AND longitude IS NOT NULL)::BIGINT FROM registry"""))
def a10(spark, sf):
    from caregrid.operators import reports as RP

    return RP.registry_profile(PL.registry(spark, sf))


@register("A16", q(O.CHAIN_VECTOR, f"""SELECT gate, value, threshold,
  CASE WHEN gate = 'indexed_share' THEN value = threshold ELSE value > threshold END AS pass FROM (
  SELECT 'description_share' AS gate, {O.rd("CAST((SELECT count_if(length(trim(coalesce(description, ''))) > 0) FROM bronze) AS DOUBLE) / CAST((SELECT count(*) FROM bronze) AS DOUBLE)", 6)} AS value, {O.dbl(0.6)} AS threshold
  UNION ALL SELECT 'extraction_success', {O.dbl(1.0)}, {O.dbl(0.85)}
  UNION ALL SELECT 'indexed_share', {O.rd("CAST((SELECT count(*) FROM vt) AS DOUBLE) / CAST((SELECT count(*) FROM gold) AS DOUBLE)", 6)}, {O.dbl(1.0)})"""))
def a16(spark, sf):
    from caregrid.operators import reports as RP

    VX, _, vt = _vector_inputs(spark, sf)
    paths = _extract_run(spark, sf)[1]
    return RP.quality_gates(PL.bronze(spark, sf), PL.gold(spark, sf), vt, stored_table(spark, paths["silver_llm"]),
                            stored_table(spark, paths["silver_llm_failures"]))


@register("F8", q(O.CHAIN_DESERTS, """SELECT pin_code, state, desert_risk_score FROM deserts
WHERE desert_risk_score >= 0.70 AND contains(desert_categories, 'EMERGENCY_DESERT')"""))
def f8(spark, sf):
    d = PL.desert_table(spark, sf)
    return DZ.desert_filter(d, high_risk_only=True, desert_type="EMERGENCY_DESERT").select(
        "pin_code", "state", "desert_risk_score")


@register("F11", q(O.CHAIN_DESERTS, f"""SELECT pin_code, state, {O.rd('centroid_lat', 6)} AS centroid_lat,
  {O.rd('centroid_lon', 6)} AS centroid_lon, desert_risk_score FROM deserts WHERE centroid_lat IS NOT NULL"""))
def f11(spark, sf):
    from caregrid.operators import reports as RP

    return RP.geo_ready_regions(PL.desert_table(spark, sf))


@register("D19", q(O.CHAIN_GOLD, """SELECT facility_id, name, coalesce(address_city, 'None') || ', ' || coalesce(address_state, 'None') AS location,
  trust_score, CASE WHEN trust_score >= 0.85 THEN 'A' WHEN trust_score >= 0.70 THEN 'B' WHEN trust_score >= 0.55 THEN 'C'
       WHEN trust_score >= 0.40 THEN 'D' ELSE 'F' END AS trust_grade,
  flag_types, flag_evidence, conf_overall AS confidence_overall, conf_low AS confidence_low, 0 AS correction_iterations, icu_present,
  vent_present, anest AS anesthesiologist, em_care AS emergency_care, sg_cardiac AS cardiac, dial_machines, 'Heuristic inference from category: ' || coalesce(category, '') AS extraction_notes
FROM gold"""))
def d19(spark, sf):
    """Trust report, flattened for comparison."""
    from caregrid.operators import reports as RP

    r, x = RP.trust_report(PL.gold(spark, sf)), F.col("extraction_summary")
    return r.select(
        "facility_id", "name", "location", "trust_score", "trust_grade", TR.flags_text("trust_flags").alias("flag_types"),
        F.array_join(F.transform("trust_flags", lambda f: f["supporting_evidence"]), " ; ").alias("flag_evidence"),
        F.col("confidence.overall").alias("confidence_overall"), F.col("confidence.confidence_interval_low").alias("confidence_low"),
        "correction_iterations", x.icu.present.alias("icu_present"), x.ventilator.present.alias("vent_present"),
        x.staff.anesthesiologist.alias("anesthesiologist"), x.emergency.emergency_care.alias("emergency_care"),
        x.surgery.cardiac.alias("cardiac"), x.dialysis.machine_count.alias("dial_machines"),
        "extraction_notes")


@register("D19P", q(O.CHAIN_GOLD, """SELECT facility_id, name, address_city AS city, address_state AS state, address_zip AS pin_code, latitude, longitude,
  facility_type, operator_type, trust_score, CAST(n_flags AS INTEGER) AS n_flags, conf_overall AS confidence_overall, 0 AS correction_iterations,
  array_to_string(specialties_list, ',') AS specialties, icu_beds FROM gold"""))
def d19_profile(spark, sf):
    """Facility profile, flattened for comparison."""
    from caregrid.operators import reports as RP

    p, c = RP.facility_profile(PL.gold(spark, sf)), F.col("capabilities")
    return p.select("facility_id", "name", "address.city", "address.state", "address.pin_code", "coordinates.latitude", "coordinates.longitude",
                    "facility_type", "operator_type", "trust_score", F.size("trust_flags").alias("n_flags"),
                    F.col("confidence.overall").alias("confidence_overall"), "correction_iterations",
                    F.array_join(c.specialties_extracted, ",").alias("specialties"), c.icu.bed_count.alias("icu_beds"))


# ---------------------------------------------------------------------------
# Merge / resume (J3, J8, J9, A3) and rule Gold (J1, D4), splits
# ---------------------------------------------------------------------------

_BATCH_SQL = f"""
batch AS (
  SELECT facility_id, name || ' v' || CAST(v AS VARCHAR) AS name,
    {O.rd('least(' + O.dbl(1.0) + ', trust_score + CAST(v AS DOUBLE) * ' + O.dbl(0.1) + ')', 3)} AS trust_score,
    src_key * 10 + v AS batch_ord
  FROM gold, (SELECT unnest([1, 2]) AS v) vv WHERE trust_score < 0.65
  UNION ALL
  SELECT sha256('supplier|' || CAST(s_suppkey AS VARCHAR)), s_name, {O.dbl(0.5)}, s_suppkey * 10 + 3 FROM supplier
),
latest AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY batch_ord DESC) = 1)"""


def _batch(spark, sf):
    from caregrid.operators import reports as RP

    return RP.correction_batch(PL.gold(spark, sf), spark, sf)


@register("A3", q(O.CHAIN_GOLD + (_BATCH_SQL,), "SELECT facility_id, name, trust_score, batch_ord FROM latest"))
def a3(spark, sf):
    from caregrid.operators.dedup import dedup_keep_last

    return dedup_keep_last(_batch(spark, sf), ["facility_id"], "batch_ord")


@register("J8", q(O.CHAIN_GOLD + (_BATCH_SQL,), """SELECT facility_id, name, trust_score, CAST(NULL AS BIGINT) AS batch_ord FROM gold
WHERE facility_id NOT IN (SELECT facility_id FROM latest)
UNION ALL SELECT facility_id, name, trust_score, batch_ord FROM latest"""))
def j8(spark, sf):
    """The upsert on a table: Gold written first, then the files that hold a key of the batch rewritten with it."""
    from caregrid.operators.upsert import upsert_table

    path = PL.table_path(spark, sf, f"gold_upsert_{uuid.uuid4().hex}")
    existing = PL.gold(spark, sf).select("facility_id", "name", "trust_score", F.lit(-1).cast("long").alias("batch_ord"))
    upsert_table(spark, existing, path, "facility_id", "batch_ord")
    return upsert_table(spark, _batch(spark, sf), path, "facility_id", "batch_ord").select(
        "facility_id", "name", "trust_score", F.nullif("batch_ord", F.lit(-1)).alias("batch_ord"))


@register("J9", q(O.CHAIN_GOLD + (_BATCH_SQL,), """SELECT g.facility_id, coalesce(l.name, g.name) AS name,
  CASE WHEN l.facility_id IS NOT NULL THEN l.trust_score ELSE g.trust_score END AS trust_score, g.address_state
FROM gold g LEFT JOIN latest l ON g.facility_id = l.facility_id"""))
def j9(spark, sf):
    from caregrid.operators.dedup import dedup_keep_last
    from caregrid.operators.upsert import update_matched

    target = PL.gold(spark, sf).select("facility_id", "name", "trust_score", "address_state")
    upd = dedup_keep_last(_batch(spark, sf), ["facility_id"], "batch_ord")
    return update_matched(target, upd, "facility_id", ["name", "trust_score"])


def _gold_versions(spark, sf):
    """A versioned Gold table: version 1 all of Gold, version 2 with the names and trust scores of the batch."""
    from caregrid.operators.dedup import dedup_keep_last
    from caregrid.sources import snapshots

    path = PL.table_path(spark, sf, f"gold_versions_{uuid.uuid4().hex}")
    snapshots.replace(spark, PL.gold(spark, sf).select("facility_id", "name", "trust_score", "address_state"), path, "facility_id", rows_per_file=2000)
    snapshots.update(spark, dedup_keep_last(_batch(spark, sf), ["facility_id"], "batch_ord"), path, "facility_id", ["name", "trust_score"], rows_per_file=2000)
    return path


@register("J9T", q(O.CHAIN_GOLD + (_BATCH_SQL,), """SELECT g.facility_id, coalesce(l.name, g.name) AS name,
  CASE WHEN l.facility_id IS NOT NULL THEN l.trust_score ELSE g.trust_score END AS trust_score, g.address_state
FROM gold g LEFT JOIN latest l ON g.facility_id = l.facility_id"""))
def j9_table(spark, sf):
    """The matched-only update on a versioned table: the newest version."""
    from caregrid.sources import snapshots

    return snapshots.read(spark, _gold_versions(spark, sf))


@register("J9H", q(O.CHAIN_GOLD + (_BATCH_SQL,), """SELECT g.facility_id, g.trust_score AS trust_before, l.trust_score AS trust_after
FROM gold g JOIN latest l ON g.facility_id = l.facility_id"""))
def j9_history(spark, sf):
    """What the update changed, by reading both versions of the table."""
    from caregrid.sources import snapshots

    path = _gold_versions(spark, sf)
    before, after = (snapshots.read(spark, path, v) for v in (1, 2))
    ids = _batch(spark, sf).select("facility_id").distinct()
    return before.select("facility_id", F.col("trust_score").alias("trust_before")).join(ids, "facility_id", "left_semi").join(
        after.select("facility_id", F.col("trust_score").alias("trust_after")), "facility_id")


@register("J3", q(O.CHAIN_VECTOR, "SELECT facility_id, src_key FROM bronze WHERE facility_id NOT IN (SELECT facility_id FROM vt)"))
def j3(spark, sf):
    from caregrid.operators.upsert import pending

    VX, _, vt = _vector_inputs(spark, sf)
    return pending(PL.bronze(spark, sf), vt, "facility_id").select("facility_id", "src_key")


@register("D4", q(O.CHAIN_RULE_GOLD, """SELECT facility_id, base_trust AS trust_score, flag_types,
  CAST(n_flags AS INTEGER) AS n_flags FROM rg_scored"""))
def d4(spark, sf):
    from caregrid.operators import reports as RP

    g = RP.rule_gold_from_heuristic_silver(PL.bronze(spark, sf), PL.table_path(spark, sf, "silver_rule"))
    return g.select("facility_id", "trust_score", TR.flags_text("trust_flags").alias("flag_types"),
                    F.size("trust_flags").alias("n_flags"))


@register("J1", q(O.CHAIN_RULE_GOLD, """SELECT facility_id, coalesce(nullif(trim(name), ''), '') AS name,
  nullif(trim(address_city), '') AS address_city FROM rg_scored"""))
def j1(spark, sf):
    from caregrid.operators import reports as RP

    return RP.rule_gold_from_heuristic_silver(PL.bronze(spark, sf), PL.table_path(spark, sf, "silver_rule")).select(
        "facility_id", "name", "address_city")


# ---------------------------------------------------------------------------
# Model jobs with the deterministic offline completer, which the oracle repeats in SQL
# ---------------------------------------------------------------------------

def _extract_run(spark, sf):
    from caregrid.operators import inference as INF

    key = ("extract_run", id(spark), sf)
    if key not in PL._STAGES:
        paths = {k: PL.table_path(spark, sf, k) for k in ("silver_llm", "silver_llm_failures", "calls_llm")}
        m = INF.run_extract(PL.bronze(spark, sf), INF.OfflineCompleter(), paths["silver_llm"],
                            paths["silver_llm_failures"], paths["calls_llm"], only_missing=False)
        PL._STAGES[key] = (m, paths)
    return PL._STAGES[key]


@register("L2", q(O.CHAIN_LLM, """SELECT facility_id, l_icu AS icu_present, l_em AS em_care, l_24 AS is_24_7, l_sg AS general_surgery,
  l_caes AS caesarean, l_dial AS dialysis, array_to_string(l_specs, ',') AS specialties, raw_text_used, prompt_tokens, completion_tokens FROM llm"""))
def l2(spark, sf):
    from caregrid.schemas import EXTRACTION

    _, paths = _extract_run(spark, sf)
    x = F.col("x")
    return stored_table(spark, paths["silver_llm"]).withColumn("x", F.from_json("extraction_json", EXTRACTION)).select(
        "facility_id", x.icu.present.alias("icu_present"), x.emergency.emergency_care.alias("em_care"), x.emergency.is_24_7.alias("is_24_7"),
        x.surgery.general_surgery.alias("general_surgery"), x.surgery.caesarean.alias("caesarean"), x.dialysis.present.alias("dialysis"),
        F.array_join(x.specialties_extracted, ",").alias("specialties"), x.raw_text_used.alias("raw_text_used"), "prompt_tokens", "completion_tokens")


@register("A12", q(O.CHAIN_LLM, """SELECT count(*)::BIGINT AS ok, 0::BIGINT AS failed, sum(prompt_tokens)::BIGINT AS prompt_tokens,
  sum(completion_tokens)::BIGINT AS completion_tokens FROM llm"""))
def a12(spark, sf):
    m, _ = _extract_run(spark, sf)
    return m


@register("L1", q(O.CHAIN_LLM, "SELECT facility_id, content, prompt_tokens, completion_tokens, CAST(NULL AS VARCHAR) AS call_error FROM llm"))
def l1(spark, sf):
    _, paths = _extract_run(spark, sf)
    return spark.read.parquet(paths["calls_llm"]).select("facility_id", "content", "prompt_tokens",
                                                         "completion_tokens", "call_error")


@register("A11", q(O.CHAIN_LLM, f"""SELECT (SELECT count(*) FROM llm)::BIGINT AS silver_rows, sum_p AS total_prompt_tokens, sum_c AS total_completion_tokens,
  (SELECT count(*) FROM gold)::BIGINT AS gold_rows, (SELECT {O.rd('avg(trust_score)', 3)} FROM gold) AS avg_trust,
  (SELECT {O.rd('avg(conf_overall)', 3)} FROM gold) AS avg_conf
FROM (SELECT sum(prompt_tokens)::BIGINT AS sum_p, sum(completion_tokens)::BIGINT AS sum_c FROM llm)"""))
def a11(spark, sf):
    """Token / yield rollup: silver rows, gold rows, avg trust, avg confidence, token sums."""
    from caregrid.operators import reports as RP

    _, paths = _extract_run(spark, sf)
    return RP.yield_rollup(stored_table(spark, paths["silver_llm"]), PL.gold(spark, sf))


def _corrected(spark, sf):
    from caregrid.operators import inference as INF

    key = ("self_correct", id(spark), sf)
    if key not in PL._STAGES:
        g, audit = INF.self_correct(PL.gold(spark, sf), PL.bronze(spark, sf), INF.OfflineCompleter(),
                                    PL.table_path(spark, sf, "correction_work"))
        gp, ap = PL.table_path(spark, sf, "gold_corrected"), PL.table_path(spark, sf, "audit_log")
        g.write.mode("overwrite").parquet(gp)
        audit.write.mode("overwrite").parquet(ap)
        PL._STAGES[key] = (spark.read.parquet(gp), spark.read.parquet(ap))
    return PL._STAGES[key]


_CORRECTED_SQL = """SELECT g.facility_id, coalesce(f.new_score, g.trust_score) AS trust_score, CASE WHEN f.facility_id IS NULL THEN 0 ELSE 1 END AS correction_iterations
FROM gold g LEFT JOIN fixed f ON g.facility_id = f.facility_id"""


@register("L4", q(O.CHAIN_CORRECTION, _CORRECTED_SQL))
def l4(spark, sf):
    g, _ = _corrected(spark, sf)
    return g.select("facility_id", "trust_score", "correction_iterations")


@register("L5", q(O.CHAIN_CORRECTION, """SELECT facility_id, event_type, agent_name, iteration, sha256(content) AS output_hash, 64 AS input_hash_length FROM calls"""))
def l5(spark, sf):
    _, a = _corrected(spark, sf)
    return a.select("facility_id", "event_type", "agent_name", "iteration", "output_hash", F.length("input_hash").alias("input_hash_length"))


# ---------------------------------------------------------------------------
# Sources, splits, selectors and scalar helpers
# ---------------------------------------------------------------------------

@register("S6", q(O.CHAIN_REGISTRY + (O.SUPPLIER_SPLIT,), """SELECT split, state, count(*)::BIGINT AS n FROM (
  SELECT 'customer' AS split, address_stateOrRegion AS state FROM registry
  UNION ALL SELECT 'supplier', trim(coalesce(statename, '')) FROM supplier_raw
) GROUP BY split, state"""))
def s6(spark, sf):
    from caregrid.sources.national import load_national, union_splits
    from caregrid.sources.testdata import national_raw, national_raw_suppliers

    sup = national_raw_suppliers(spark, sf).select(
        "src_key", "src_ord", F.col("alt_name").alias("prmry_name"), F.col("y").alias("latitude"),
        F.col("x").alias("longitude"), "statename", "lganame")
    # splits of one source share its column names; absent columns (type, category, ...) become null
    raw = union_splits([national_raw(spark, sf).withColumn("split", F.lit("customer")),
                        sup.withColumn("split", F.lit("supplier"))])
    reg = load_national(raw, keep=("src_key", "split"))
    return reg.groupBy("split", F.col("address_stateOrRegion").alias("state")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))


@register("U1", q(O.CHAIN_REGISTRY + (O.SUPPLIER_SPLIT,), f"""SELECT prmry_name AS name,
  {O.rd('latitude', 6)} AS latitude, {O.rd('longitude', 6)} AS longitude FROM supplier_raw
UNION ALL SELECT name, {O.rd('latitude', 6)}, {O.rd('longitude', 6)} FROM registry"""))
def u1(spark, sf):
    from caregrid.sources.national import load_national, union_splits
    from caregrid.sources.testdata import national_raw, national_raw_suppliers

    # the supplier split has no category/type columns: S7 falls back to alt_name / y / x by presence
    sup = load_national(national_raw_suppliers(spark, sf))
    both = union_splits([PL.registry(spark, sf).select("name", "latitude", "longitude"),
                         sup.select("name", "latitude", "longitude")])
    return both.select("name", rnd("latitude", 6).alias("latitude"), rnd("longitude", 6).alias("longitude"))


@register("S12", q(O.CHAIN_REGISTRY, f"""SELECT src_ord, {O.sent('address_zipOrPostcode')} AS zip,
  {O.sent('name')} AS name FROM registry"""))
def s12(spark, sf):
    from caregrid.operators.bronze import normalise_nas

    reg = PL.registry(spark, sf).select("src_ord", F.col("address_zipOrPostcode").alias("zip"), "name")
    return normalise_nas(reg)


@register("F4", q(O.CHAIN_GOLD, "SELECT facility_id, trust_score FROM gold WHERE trust_score < 0.65"))
def f4(spark, sf):
    return PL.gold(spark, sf).where(F.col("trust_score") < 0.65).select("facility_id", "trust_score")


@register("F3", q(O.CHAIN_GOLD, "SELECT facility_id, trust_score FROM gold ORDER BY facility_id LIMIT 50"))
def f3(spark, sf):
    """Deterministic sample (the sampling operator itself: first n by id)."""
    return PL.gold(spark, sf).orderBy("facility_id").limit(50).select("facility_id", "trust_score")


@register("X7", q(O.CHAIN_GOLD, """SELECT facility_id, icu_present, sg_general AS general_surgery,
  CAST(icu_beds AS VARCHAR) AS bed_count FROM gold"""))
def x7(spark, sf):
    j = F.to_json("extraction")
    g = PL.gold(spark, sf)
    return g.select("facility_id", F.get_json_object(j, "$.icu.present").alias("icu_present"),
                    F.get_json_object(j, "$.surgery.general_surgery").alias("general_surgery"),
                    F.get_json_object(j, "$.icu.bed_count").alias("bed_count"))


@register("X8", q(O.CHAIN_GOLD, f"""SELECT facility_id, CAST(icu_present IN {O.P} AS INTEGER) AS has_icu,
  CAST(dial_present IN {O.P} AS INTEGER) AS has_dialysis, CAST(em_care IN {O.P} AS INTEGER) AS has_emergency,
  CAST(sg_general IN {O.P} AS INTEGER) AS has_surgery FROM gold"""))
def x8(spark, sf):
    from caregrid.functions.core import is_present

    ex = F.col("extraction")
    return PL.gold(spark, sf).select(
        "facility_id", is_present(ex.icu.present).cast("int").alias("has_icu"),
        is_present(ex.dialysis.present).cast("int").alias("has_dialysis"),
        is_present(ex.emergency.emergency_care).cast("int").alias("has_emergency"),
        is_present(ex.surgery.general_surgery).cast("int").alias("has_surgery"))


@register("X9", q(O.CHAIN_BRONZE, """SELECT facility_id, substr(composite_text, 1, 300) AS text_300,
  substr(composite_text, 1, 1000) AS text_1000 FROM bronze"""))
def x9(spark, sf):
    from caregrid.functions.text import truncate

    return PL.bronze(spark, sf).select("facility_id", truncate("composite_text", 300).alias("text_300"),
                                       truncate("composite_text", 1000).alias("text_1000"))


# ---------------------------------------------------------------------------
# Sinks and model-side reports (rows-only: they read what the model jobs wrote)
# ---------------------------------------------------------------------------

@register("S8", q(O.CHAIN_LLM, """SELECT g.facility_id, g.name, coalesce(g.address_city, '') AS address_city, g.facility_type, g.trust_score,
  l.prompt_tokens, l.completion_tokens FROM gold g JOIN llm l ON g.facility_id = l.facility_id"""))
def s8(spark, sf):
    """CSV sink of the Gold x Silver summary ordered by trust, read back and typed."""
    from caregrid.sources.files import read_csv_all_string, write_csv

    _, paths = _extract_run(spark, sf)
    silver = stored_table(spark, paths["silver_llm"])
    summary = (PL.gold(spark, sf).join(silver, "facility_id", "inner")
               .select("facility_id", "name", "address_city", "address_state", "facility_type", "trust_score",
                       "prompt_tokens", "completion_tokens", "latency_ms")
               .orderBy(F.desc("trust_score"), "facility_id"))
    path = PL.table_path(spark, sf, "llm_summary_csv")
    write_csv(summary, path)
    back = read_csv_all_string(spark, path, summary.columns)
    return back.select("facility_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("address_city", F.lit("")).alias("address_city"),
                       "facility_type", F.col("trust_score").try_cast("double").alias("trust_score"),
                       *[F.col(c).try_cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens")])


@register("S9", q(O.CHAIN_DESERTS, f"""SELECT pin_code, state, {O.rd('centroid_lat', 6)} AS centroid_lat,
  {O.rd('centroid_lon', 6)} AS centroid_lon, desert_risk_score FROM deserts WHERE centroid_lat IS NOT NULL"""))
def s9(spark, sf):
    """JSON sink of geo-ready regions, read back with an explicit schema."""
    from caregrid.operators import reports as RP
    from caregrid.sources.files import write_json

    path = PL.table_path(spark, sf, "regions_json")
    regions = RP.geo_ready_regions(PL.desert_table(spark, sf))
    write_json(regions, path)
    return spark.read.schema(regions.schema).json(path)


@register("J7", q(O.CHAIN_LLM, """SELECT g.facility_id, g.trust_score, l.prompt_tokens, l.completion_tokens
FROM gold g JOIN llm l ON g.facility_id = l.facility_id"""))
def j7(spark, sf):
    _, paths = _extract_run(spark, sf)
    return PL.gold(spark, sf).join(stored_table(spark, paths["silver_llm"]), "facility_id", "inner").select(
        "facility_id", "trust_score", "prompt_tokens", "completion_tokens")


@register("F10", q(O.CHAIN_LLM, """SELECT g.facility_id, g.trust_score, l.prompt_tokens FROM gold g JOIN llm l ON g.facility_id = l.facility_id
WHERE g.trust_score > 0.5 AND l.prompt_tokens > 0 AND l.completion_tokens > 0"""))
def f10(spark, sf):
    _, paths = _extract_run(spark, sf)
    s = stored_table(spark, paths["silver_llm"])
    return (PL.gold(spark, sf).join(s, "facility_id").where(
        (F.col("trust_score") > 0.5) & (F.col("prompt_tokens") > 0) & (F.col("completion_tokens") > 0))
        .select("facility_id", "trust_score", "prompt_tokens"))


@register("A14", q(O.CHAIN_GOLD, """SELECT 'bronze' AS layer, true AS ready, count(*)::BIGINT AS rows FROM bronze
UNION ALL SELECT 'gold', true, count(*)::BIGINT FROM gold UNION ALL SELECT 'deserts', false, 0::BIGINT"""))
def a14(spark, sf):
    """Readiness counts per layer (a missing table counts as not ready)."""
    from caregrid.operators import reports as RP

    tables = {"bronze": PL.table_path(spark, sf, "bronze"), "gold": PL.table_path(spark, sf, "gold"),
              "deserts": PL.table_path(spark, sf, "deserts_never_built")}
    PL.gold(spark, sf)
    return RP.readiness(spark, tables)


@register("A15", q(O.CHAIN_LLM, """SELECT g.facility_id, b.composite_text_length, g.trust_score, l.prompt_tokens + l.completion_tokens AS tokens,
  CAST(g.n_flags AS INTEGER) AS n_flags, CAST(g.n_high AS INTEGER) AS n_high_flags, 0 AS correction_iterations
FROM gold g JOIN llm l ON g.facility_id = l.facility_id JOIN bronze b ON g.facility_id = b.facility_id"""))
def a15(spark, sf):
    from caregrid.operators import reports as RP

    _, paths = _extract_run(spark, sf)
    # latency differs from run to run
    return RP.trace_metrics(PL.gold(spark, sf), stored_table(spark, paths["silver_llm"]), PL.bronze(spark, sf)).drop("latency_ms")


@register("X12", q(O.CHAIN_VECTOR, f"""SELECT g.facility_id, coalesce(g.address_city, '') || ', ' || coalesce(g.address_state, '') || ' - ' || coalesce(g.address_zip, '') AS location,
  {O.rd('coalesce(g.trust_score, 0.0)', 3)} AS trust_score, g.conf_overall AS confidence_overall, CAST(least(10, len(g.specialties_list)) AS INTEGER) AS n_specialties
FROM gold g JOIN vt ON g.facility_id = vt.facility_id"""))
def x12(spark, sf):
    from caregrid.operators import rank as RK

    VX, _, vt = _vector_inputs(spark, sf)
    return RK.candidate_summary(vt).select("facility_id", "location", "trust_score", "confidence_overall",
                                           F.size("capabilities.specialties").alias("n_specialties"))


@register("X15", q(O.CHAIN_RANK, """SELECT query_id, CAST(count(*) AS INTEGER) AS n_ranked, '' AS errors, 'asked: ' || query_id AS query_interpretation, '' AS uncertainty_note,
  string_agg(facility_id, ',' ORDER BY rank) AS facilities FROM ranked GROUP BY query_id
UNION ALL SELECT -query_id - 1, CAST(NULL AS INTEGER), 'invalid ranked result', NULL, NULL, NULL FROM ranked WHERE rank = 1"""))
def x15(spark, sf):
    """Ranking replies built from the deterministic ranker's output (as a model would return them), parsed back;
    each also without its suitability scores, which must be rejected."""
    from caregrid.functions.parse import parse_ranking

    r = _ranked(spark, sf)[0]
    fields = ("rank", "facility_id", "facility_name", "reasoning", "matched_capabilities", "warnings")
    listed = lambda *more: F.sort_array(F.collect_list(F.struct(*fields, *more))).alias("ranked_results")
    said = F.concat(F.lit("asked: "), F.col("query_id").cast("string")).alias("query_interpretation")
    both = r.groupBy("query_id").agg(listed("suitability_score").alias("good"), listed().alias("bad")).select("query_id", F.explode(F.array(
        F.struct(F.col("query_id").alias("id"), F.to_json(F.struct(said, F.col("good").alias("ranked_results"))).alias("content")),
        F.struct((-F.col("query_id") - 1).alias("id"), F.to_json(F.struct(said, F.col("bad").alias("ranked_results"))).alias("content")))).alias("x"))
    p = parse_ranking(both.select(F.col("x.id").alias("query_id"), "x.content"))
    items = F.col("reply.ranked_results")
    return p.select("query_id", F.when(F.col("reply").isNotNull(), F.size(items)).alias("n_ranked"), F.array_join("errors", "; ").alias("errors"),
                    "reply.query_interpretation", "reply.uncertainty_note",
                    F.array_join(F.transform(items, lambda i: i["facility_id"]), ",").alias("facilities"))


@register("V1", q(O.CHAIN_GOLD, """SELECT facility_id, array_to_string(list_transform(range(64), lambda i: CAST(round(CAST(CAST(coalesce(list_extract(map_extract(m, i), 1), 0) / (norm + 1e-12) AS FLOAT) AS DOUBLE) * 10000) AS BIGINT)), ',') AS vector
FROM (
  SELECT facility_id, map_from_entries(list(row(i, v))) AS m, sqrt(sum(v * v)) AS norm FROM (
    SELECT facility_id, CAST('0x' || substr(h, 1, 4) AS INTEGER) % 64 AS i,
      CAST(sum(CASE WHEN contains('13579bdf', substr(h, 5, 1)) THEN 1 ELSE -1 END) AS DOUBLE) AS v
    FROM (SELECT facility_id, md5(unnest(regexp_extract_all(lower(embedding_text), '[a-z0-9]+'))) AS h FROM gold) GROUP BY 1, 2
  ) GROUP BY 1
)"""))
def v1(spark, sf):
    from caregrid.operators.vector import HashingEmbedder, embed_texts

    emb = embed_texts(PL.gold(spark, sf).select("facility_id", "embedding_text"), "embedding_text",
                      HashingEmbedder(64), 64)
    return emb.select("facility_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string")), ",").alias("vector"))


@register("W7", q(O.CHAIN_CORRECTION, _CORRECTED_SQL))
def w7(spark, sf):
    g, _ = _corrected(spark, sf)
    return g.select("facility_id", "trust_score", "correction_iterations")


# ---------------------------------------------------------------------------
# Remaining inventory ids
# ---------------------------------------------------------------------------

@register("F2", q(O.CHAIN_BRONZE, "SELECT facility_id FROM bronze WHERE length(composite_text) > 0"))
def f2(spark, sf):
    return PL.bronze(spark, sf).where(F.length("composite_text") > 0).select("facility_id")


@register("F7", q(O.CHAIN_GOLD, """SELECT facility_id, address_zip FROM gold
WHERE address_zip IS NOT NULL AND length(trim(address_zip)) > 0"""))
def f7(spark, sf):
    g = PL.gold(spark, sf)
    return g.where(F.col("address_zip").isNotNull() & (F.length(F.trim("address_zip")) > 0)).select(
        "facility_id", "address_zip")


@register("F6", q(O.CHAIN_VECTOR, """SELECT q.query_id, CAST(count(g.facility_id) AS BIGINT) AS n_matching
FROM vq q LEFT JOIN gold g ON lower(coalesce(g.address_state, '')) = lower(q.state)
WHERE q.state IS NOT NULL GROUP BY q.query_id"""))
def f6(spark, sf):
    """Case-insensitive state filter per query: Gold is pre-aggregated per state before the join,
    so a state holding a third of all rows costs one row, not a third of the table."""
    _, qs, _ = _vector_inputs(spark, sf)
    per_state = PL.gold(spark, sf).groupBy(F.lower(F.coalesce("address_state", F.lit(""))).alias("_s")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    q = qs.where(F.col("state").isNotNull()).select("query_id", F.lower("state").alias("_s"))
    return q.join(per_state, "_s", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_matching"))


@register("F9", q(O.CHAIN_VECTOR + (O.prefilter_sql(5),), """SELECT DISTINCT h.facility_id, g.name, g.trust_score
FROM hits h JOIN gold g ON h.facility_id = g.facility_id"""))
def f9(spark, sf):
    """Point lookups in bulk: the facilities recommended by search, looked up in Gold (semi-join)."""
    VX, qs, vt = _vector_inputs(spark, sf)
    ids = VX.search(qs, vt, top_k=5).select("facility_id").distinct()
    return PL.gold(spark, sf).join(ids, "facility_id", "left_semi").select("facility_id", "name", "trust_score")


@register("J2", q(O.CHAIN_BRONZE, """SELECT facility_id, coalesce(category, '') AS category,
  coalesce(functional_status, '') AS functional_status, coalesce(accessibility_note, '') AS accessibility_note
FROM bronze"""))
def j2(spark, sf):
    """Left join of Bronze <- source attributes (deduplicated first), missing -> ''."""
    from caregrid.functions.core import hash_id
    from caregrid.functions.text import clean_postcode
    from caregrid.operators.dedup import dedup_keep_first
    from caregrid.functions.core import sentinel_null

    reg = PL.registry(spark, sf)
    attrs = reg.select(
        hash_id(sentinel_null("name"), sentinel_null("address_city"), clean_postcode(sentinel_null("address_zipOrPostcode")))
        .alias("facility_id"), "src_ord", "category", "functional_status", "accessibility_note")
    attrs = dedup_keep_first(attrs, ["facility_id"], "src_ord").drop("src_ord")
    b = PL.bronze(spark, sf).select("facility_id")
    j = b.join(attrs, "facility_id", "left")
    return j.select("facility_id", *[F.coalesce(c, F.lit("")).alias(c)
                                     for c in ("category", "functional_status", "accessibility_note")])


@register("J4", q(O.CHAIN_GOLD, """SELECT g.facility_id, b.composite_text_length FROM gold g
LEFT JOIN bronze b ON g.facility_id = b.facility_id WHERE g.trust_score < 0.65"""))
def j4(spark, sf):
    low = PL.gold(spark, sf).where(F.col("trust_score") < 0.65).select("facility_id")
    return low.join(PL.bronze(spark, sf).select("facility_id", "composite_text_length"), "facility_id", "left")


@register("P5", q(O.CHAIN_BRONZE, """SELECT facility_id, composite_text_length,
  CAST(length(coalesce(name, '')) AS INTEGER) AS name_length FROM bronze"""))
def p5(spark, sf):
    return PL.bronze(spark, sf).select("facility_id", "composite_text_length",
                                       F.length(F.coalesce("name", F.lit(""))).alias("name_length"))


@register("P7", """SELECT event_id,
  TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_double,
  CAST(trunc(TRY_CAST(json_extract_string(props, '$.k') || '.7' AS DOUBLE)) AS BIGINT) AS k_long,
  CAST(NULL AS DOUBLE) AS junk_double
FROM events""")
def p7(spark, sf):
    from caregrid.functions.text import to_double, to_long
    from caregrid.sources.testdata import read_table

    e = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", to_double(k).alias("k_double"), to_long(F.concat(k, F.lit(".7"))).alias("k_long"),
                    to_double(F.concat(F.lit("n/a "), k)).alias("junk_double"))


@register("P12", q(O.CHAIN_BRONZE, "SELECT facility_id, true AS has_ingest_ts FROM bronze"))
def p12(spark, sf):
    return PL.bronze(spark, sf).select("facility_id", F.col("_ingest_ts").isNotNull().alias("has_ingest_ts"))


@register("P13", q(O.CHAIN_REGISTRY, "SELECT src_ord, operatorTypeId, accessibility_note, address_zipOrPostcode FROM registry"))
def p13(spark, sf):
    return PL.registry(spark, sf).select("src_ord", "operatorTypeId", "accessibility_note", "address_zipOrPostcode")


@register("X14", q(O.CHAIN_REGISTRY, """SELECT src_ord, nullif(trim(name), '') AS name,
  nullif(trim(accessibility_note), '') AS accessibility_note FROM registry"""))
def x14(spark, sf):
    from caregrid.functions.core import clean_str

    return PL.registry(spark, sf).select("src_ord", clean_str("name").alias("name"),
                                         clean_str("accessibility_note").alias("accessibility_note"))


@register("S2", q(O.CHAIN_REGISTRY, """SELECT src_ord, name, CAST(NULL AS VARCHAR) AS phone_numbers,
  CAST(NULL AS VARCHAR) AS yearEstablished FROM registry"""))
def s2(spark, sf):
    from caregrid.operators.bronze import project_kept

    return project_kept(PL.registry(spark, sf), carry=("src_ord",)).select(
        "src_ord", "name", "phone_numbers", "yearEstablished")


@register("S10", q(O.CHAIN_REGISTRY, "SELECT src_ord, address_city, coalesce(category, '') AS category FROM registry"))
def s10(spark, sf):
    """Dual sink (Parquet + CSV) of the loader output; the CSV copy is read back with S1."""
    from caregrid.sources.files import read_csv_all_string, write_parquet_and_csv

    pq, csv = PL.table_path(spark, sf, "registry_parquet"), PL.table_path(spark, sf, "registry_csv")
    write_parquet_and_csv(PL.registry(spark, sf).select("src_ord", "name", "address_city", "category"), pq, csv)
    back = read_csv_all_string(spark, csv, ["src_ord", "name", "address_city", "category"])
    return back.select(F.col("src_ord").cast("long").alias("src_ord"), "address_city",
                       F.coalesce("category", F.lit("")).alias("category"))


@register("S1", q(O.CHAIN_REGISTRY, "SELECT src_ord, address_city FROM registry"))
def s1(spark, sf):
    """CSV scan with header, quoted multi-line fields, every column as text, then typed with try_cast."""
    from caregrid.sources.files import read_csv_all_string

    s10(spark, sf)
    back = read_csv_all_string(spark, PL.table_path(spark, sf, "registry_csv"))
    return back.select(F.col("src_ord").try_cast("long").alias("src_ord"), "address_city")


@register("S3", q(O.CHAIN_GOLD, "SELECT facility_id, trust_score FROM gold"))
def s3(spark, sf):
    from pyspark.sql import types as T

    from caregrid.sources.files import read_table

    PL.gold(spark, sf)
    schema = T.StructType([T.StructField("facility_id", T.StringType()), T.StructField("trust_score", T.DoubleType())])
    return read_table(spark, PL.table_path(spark, sf, "gold"), schema)


@register("A1I", q(O.CHAIN_DESERTS, "SELECT pin_code, state, facility_count, desert_risk_score, desert_risk_score >= 0.70 AS is_high_risk FROM deserts"))
def a1_incremental(spark, sf):
    """Desert aggregates refreshed from the changes between versions of Gold: two thirds of it, then the rest, then a rewrite."""
    from caregrid.operators import desert_state as DS
    from caregrid.sources import snapshots

    root = PL.table_path(spark, sf, f"desert_state_{uuid.uuid4().hex}")
    g = PL.gold(spark, sf).select("facility_id", *DS.NEEDED, F.lit(0).alias("ord"))
    third = F.pmod(F.xxhash64("facility_id"), F.lit(3))
    moved = g.withColumn("address_zip", F.when(third == 0, F.lit("0")).otherwise(F.col("address_zip")))
    for batch in (moved.where(third < 2), g.where(third == 2), g.where(third == 0)):
        snapshots.upsert(spark, batch, f"{root}/gold", "facility_id", "ord", 500)
        DS.refresh(spark, f"{root}/gold", f"{root}/areas")
    return DS.deserts(spark, f"{root}/areas").select("pin_code", "state", "facility_count", "desert_risk_score", "is_high_risk")


@register("S4", q(O.CHAIN_DESERTS, "SELECT pin_code, state, desert_risk_score FROM deserts"))
def s4(spark, sf):
    from caregrid.sources.files import write_table

    path = PL.table_path(spark, sf, "deserts_s4")
    write_table(PL.desert_table(spark, sf).select("pin_code", "state", "desert_risk_score"), path, mode="overwrite")
    return spark.read.parquet(path)


@register("S5V", q(O.CHAIN_GOLD, "SELECT facility_id, CAST(2 AS BIGINT) AS copies FROM gold"))
def s5_versions(spark, sf):
    """S4 and S5 on a versioned table: one write, one append, both visible in the newest version."""
    from caregrid.sources import snapshots

    path = PL.table_path(spark, sf, f"gold_appended_{uuid.uuid4().hex}")
    g = PL.gold(spark, sf).select("facility_id")
    snapshots.replace(spark, g, path)
    snapshots.append(spark, g, path)
    return stored_table(spark, path).groupBy("facility_id").agg(F.count(F.lit(1)).cast("long").alias("copies"))


@register("S5", q(O.CHAIN_GOLD, "SELECT facility_id, CAST(2 AS BIGINT) AS copies FROM gold"))
def s5(spark, sf):
    from caregrid.sources.files import write_table

    path = PL.table_path(spark, sf, "gold_appended")
    g = PL.gold(spark, sf).select("facility_id")
    write_table(g, path, mode="overwrite")
    write_table(g, path, mode="append")
    return spark.read.parquet(path).groupBy("facility_id").agg(F.count(F.lit(1)).cast("long").alias("copies"))


@register("S11", q(O.CHAIN_DESERTS, "SELECT state, count(*)::BIGINT AS areas FROM deserts GROUP BY state"))
def s11(spark, sf):
    from caregrid.sources.files import register_views

    path = PL.table_path(spark, sf, "deserts_s11")
    PL.desert_table(spark, sf).write.mode("overwrite").parquet(path)
    register_views(spark, {"deserts_v": path, "missing_v": path + "_absent"})
    return spark.sql("SELECT state, CAST(count(*) AS BIGINT) AS areas FROM deserts_v GROUP BY state")


@register("U2", q(O.CHAIN_GOLD + (_BATCH_SQL,), "SELECT facility_id FROM gold WHERE facility_id NOT IN (SELECT facility_id FROM batch)"))
def u2(spark, sf):
    from caregrid.operators.upsert import pending

    return pending(PL.gold(spark, sf).select("facility_id"), _batch(spark, sf), "facility_id")


@register("W2", q(O.CHAIN_RANK, "SELECT query_id, rank, facility_id, retrieval_rank FROM ranked"))
def w2(spark, sf):
    return _ranked(spark, sf)[0].select("query_id", "rank", "facility_id", "retrieval_rank")


@register("X11", q(O.CHAIN_LLM, """SELECT facility_id, 2 AS n_messages, sha256(user_msg) AS user_hash FROM llm"""))
def x11(spark, sf):
    from caregrid.operators.inference import extraction_messages

    m = extraction_messages("composite_text", "facility_id")
    b = PL.bronze(spark, sf).select("facility_id", m.alias("messages"))
    return b.select("facility_id", F.size("messages").alias("n_messages"), F.sha2(F.col("messages")[1]["content"], 256).alias("user_hash"))


@register("L3", q(O.CHAIN_CORRECTION, "SELECT iteration, event_type, count(*)::BIGINT AS calls FROM calls GROUP BY 1, 2"))
def l3(spark, sf):
    """Validate -> correct rounds: calls per (round, step) from the audit rows."""
    _, a = _corrected(spark, sf)
    return a.groupBy("iteration", "event_type").agg(F.count(F.lit(1)).cast("long").alias("calls"))


def _model_pipeline(spark, sf):
    from caregrid.operators.inference import OfflineCompleter, pipeline
    from caregrid.operators.vector import HashingEmbedder, embed_texts

    key = ("model_pipeline", id(spark), spark.sparkContext.applicationId, sf)
    if key not in PL._STAGES:
        PL._STAGES[key] = pipeline(spark, PL.registry(spark, sf), PL.table_path(spark, sf, "pipeline_run"), completer=OfflineCompleter(),
                                   embed=lambda g: embed_texts(g, "embedding_text", HashingEmbedder(64), 64))
    return PL._STAGES[key]


@register("L6", q(O.CHAIN_LLM_DESERTS, """SELECT pin_code, state, desert_risk_score, desert_categories, (SELECT count(*) FROM gold WHERE redo)::BIGINT AS corrected FROM deserts"""))
def l6(spark, sf):
    """The whole pipeline on the model path: extract, rule Gold, correct, index, deserts."""
    paths = _model_pipeline(spark, sf)
    gold = stored_table(spark, paths["gold"])
    n = gold.agg(F.count_if(F.col("correction_iterations") > 0).cast("long").alias("corrected"))
    d = spark.read.parquet(paths["deserts"])
    return d.select("pin_code", "state", "desert_risk_score", F.array_join("desert_categories", ",").alias("desert_categories"),
                    n.scalar().alias("corrected"))


@register("L6N", q((O.RAW, O.LOADED, O.BRONZE, O.OFFLINE, O.LLM_RULES, O.REQUESTS, f"""
pairs AS (SELECT r.request_id, r.radius_km, g.facility_id, {O.rd(O.hav_sql('r.lat', 'r.lon', 'g.latitude', 'g.longitude'), 2)} AS distance_km
  FROM req r, gold g WHERE g.latitude IS NOT NULL AND g.longitude IS NOT NULL AND (r.min_trust_score <= 0 OR g.trust_score >= r.min_trust_score))"""),
  "SELECT request_id, CAST(least(5, count(*)) AS BIGINT) AS n FROM pairs WHERE distance_km <= radius_km GROUP BY request_id"))
def l6_nearest(spark, sf):
    """D11 over the model path's Gold, which has no category or status columns."""
    from caregrid.operators import geo as GEO
    from caregrid.sources.testdata import nearest_requests

    gold = stored_table(spark, _model_pipeline(spark, sf)["gold"])
    return GEO.rank_nearest(nearest_requests(spark, sf), gold).groupBy("request_id").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("S1I", q(O.CHAIN_BRONZE, "SELECT facility_id, name, address_city, latitude, composite_text_length FROM bronze"))
def s1_ingest(spark, sf):
    """A registry file to Bronze: the loader output written as CSV in source order, read back and ingested."""
    from caregrid.operators.bronze import ingest
    from caregrid.schemas import KEPT_COLUMNS
    from caregrid.sources.files import read_registry_csv, write_csv

    path = PL.table_path(spark, sf, "registry_ordered_csv")
    reg = PL.registry(spark, sf)
    cols = [c for c in KEPT_COLUMNS if c in reg.columns]
    write_csv(reg.orderBy("src_ord").select(*cols), path)
    return ingest(read_registry_csv(spark, path, cols)).select("facility_id", "name", "address_city", "latitude", "composite_text_length")


@register("S1M", "SELECT doc_id, md5(text) AS text_md5, length(text) - length(replace(text, chr(10), '')) AS n_breaks FROM documents")
def s1_multi_line(spark, sf):
    """Whole texts with their line breaks, written as CSV and read back by the splittable reader."""
    from caregrid.sources.csv_records import read_csv_records

    path = PL.table_path(spark, sf, f"documents_csv_{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows, _ = read_csv_records(spark, path, ["doc_id", "text"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"),
                       (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("n_breaks"))


@register("J1B", q(O.CHAIN_GOLD, "SELECT g.facility_id, b.composite_text_length, g.trust_score FROM gold g JOIN bronze b ON g.facility_id = b.facility_id"))
def j1_bucketed(spark, sf):
    """Gold meets Bronze on facility_id, both bucketed and sorted by it: the join reads them without a shuffle."""
    from caregrid.sources.bucketed import buckets_for, open_bucketed, write_bucketed

    tables, n = [PL.gold(spark, sf), PL.bronze(spark, sf)], None
    for i, df in enumerate(tables):
        n = n or buckets_for(df.count())
        path = PL.table_path(spark, sf, f"by_facility_{uuid.uuid4().hex}")
        write_bucketed(df, path, "facility_id", n)
        tables[i] = open_bucketed(spark, path)
    gold, bronze = tables
    return gold.select("facility_id", "trust_score").join(bronze.select("facility_id", "composite_text_length"), "facility_id")


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
