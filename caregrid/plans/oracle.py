"""Oracle SQL (DuckDB dialect) for the driver's correctness gate.

Written by hand as plain SQL over the pre-registered views, independently of
the Spark expressions: CTE blocks for the derived registry, Bronze, heuristic
Gold and deserts, composed into one statement per query. Every double that a
query outputs is rounded through decimal(18,9) exactly as the Spark side does.
"""

from __future__ import annotations


def rd(x: str, n: int) -> str:
    return f"CAST(round(CAST(({x}) AS DECIMAL(18,9)), {n}) AS DOUBLE)"


def sent(x: str) -> str:
    return f"(CASE WHEN lower(trim({x})) IN ('nan','<na>','none','') THEN NULL ELSE {x} END)"


def dbl(v) -> str:
    return f"CAST({v} AS DOUBLE)"


P = "('confirmed','claimed')"
DA = "('confirmed','claimed','not_present')"
DS = "('full_time','part_time','visiting','on_call')"
RS = "('full_time','on_call')"

RAW = """
raw_base AS (
  SELECT c.c_custkey AS k, c.c_name, c.c_acctbal, c.c_mktsegment, n.n_name, r.r_name,
         unnest(CASE WHEN c.c_custkey % 41 = 0 THEN [0, 1] ELSE [0] END) AS copy
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey
),
raw_national AS (
  SELECT k AS src_key, k * 2 + copy AS src_ord,
    CASE WHEN k % 97 = 0 THEN NULL WHEN k % 89 = 0 THEN '  ' ELSE c_name END AS prmry_name,
    CASE WHEN k % 29 = 0 THEN NULL
         ELSE (CAST(4.0 AS DOUBLE) + CAST((k * 7919) % 10000 AS DOUBLE) / CAST(1000.0 AS DOUBLE))
              + CAST(copy AS DOUBLE) * CAST(0.5 AS DOUBLE) END AS latitude,
    CASE WHEN k % 29 = 0 THEN NULL
         ELSE CAST(3.0 AS DOUBLE) + CAST((k * 10473) % 11000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) END AS longitude,
    r_name AS statename, n_name AS lganame,
    CASE WHEN k % 31 = 0 THEN NULL WHEN k % 53 = 0 THEN 'nan'
         WHEN k % 17 = 0 THEN 'Ward-' || CAST(k % 40 AS VARCHAR) || '.0'
         ELSE 'Ward-' || CAST(k % 40 AS VARCHAR) END AS wardname,
    CASE WHEN k % 23 = 0 THEN NULL
         WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Hospital'
         WHEN c_mktsegment = 'MACHINERY' THEN 'Primary Health Care Centre'
         WHEN c_mktsegment = 'FURNITURE' THEN 'Dental Clinic'
         WHEN c_mktsegment = 'BUILDING' THEN 'Pharmacy Store'
         WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Laboratory' ELSE 'Clinic' END AS type,
    CASE k % 12 WHEN 0 THEN 'Teaching Hospital' WHEN 1 THEN 'Federal Medical Centre'
         WHEN 2 THEN 'Specialist Hospital' WHEN 3 THEN 'General Hospital' WHEN 4 THEN 'District Hospital'
         WHEN 5 THEN 'Cottage Hospital' WHEN 6 THEN 'Comprehensive Health Centre' WHEN 7 THEN 'Medical Center'
         WHEN 8 THEN 'Maternity Home' WHEN 9 THEN 'Primary Health Centre' WHEN 10 THEN 'Dispensary'
         ELSE '' END AS category,
    CASE k % 7 WHEN 4 THEN 'Not Functional' WHEN 5 THEN 'Partially Functional' WHEN 6 THEN NULL
         ELSE 'Functional' END AS func_stats,
    CASE WHEN c_acctbal < 0 THEN 'Private' ELSE 'Public' END AS ownership,
    CASE k % 3 WHEN 0 THEN 'Accessible all year' WHEN 1 THEN 'Seasonal access' ELSE NULL END AS accessblty
  FROM raw_base
)"""

LOADED = """
loaded0 AS (
  SELECT src_ord, src_key, trim(coalesce(prmry_name, '')) AS name, latitude, longitude,
    trim(coalesce(statename, '')) AS address_stateOrRegion,
    trim(coalesce(lganame, '')) AS address_city,
    trim(coalesce(wardname, '')) AS address_zipOrPostcode,
    lower(trim(coalesce(type, ''))) AS type_l,
    trim(coalesce(category, '')) AS category,
    trim(coalesce(func_stats, '')) AS functional_status,
    trim(coalesce(ownership, '')) AS operatorTypeId,
    trim(coalesce(accessblty, '')) AS accessibility_note
  FROM raw_national
),
loaded1 AS (
  SELECT *,
    CASE WHEN contains(type_l, 'hospital') THEN 'hospital'
         WHEN contains(type_l, 'health centre') THEN 'clinic'
         WHEN contains(type_l, 'health center') THEN 'clinic'
         WHEN contains(type_l, 'clinic') THEN 'clinic'
         WHEN contains(type_l, 'dispensary') THEN 'clinic'
         WHEN contains(type_l, 'maternity') THEN 'clinic'
         WHEN contains(type_l, 'pharmacy') THEN 'pharmacy'
         WHEN contains(type_l, 'laboratory') THEN 'clinic'
         WHEN contains(type_l, 'dental') THEN 'dentist'
         WHEN contains(type_l, 'dentist') THEN 'dentist'
         WHEN contains(type_l, 'doctor') THEN 'doctor'
         WHEN contains(type_l, 'primary health care') THEN 'clinic'
         WHEN contains(type_l, 'phc') THEN 'clinic'
         ELSE 'unknown' END AS facilityTypeId,
    CASE WHEN contains(lower(category), 'teaching') OR contains(lower(category), 'federal medical')
           THEN 'ICU, emergency care, surgery, dialysis, specialist services, 24/7 emergency'
         WHEN contains(lower(category), 'specialist') THEN 'specialist care, emergency care, surgery'
         WHEN contains(lower(category), 'general hospital') OR contains(lower(category), 'district hospital')
              OR contains(lower(category), 'cottage')
           THEN 'emergency care, general surgery, maternity, inpatient care'
         WHEN contains(lower(category), 'comprehensive') THEN 'emergency care, maternity, general surgery'
         WHEN contains(lower(category), 'maternity') THEN 'maternity, antenatal care, postnatal care, normal delivery'
         WHEN contains(lower(category), 'medical center') THEN 'emergency care, outpatient care'
         WHEN contains(lower(category), 'primary') OR contains(lower(category), 'dispensary')
              OR contains(lower(category), 'community')
           THEN 'outpatient care, primary care, immunisation, antenatal'
         ELSE '' END AS capability
  FROM loaded0
),
loaded2 AS (
  SELECT *,
    trim('Facility: ' || trim(name) || '. Category: ' || category || '. Ownership: ' || operatorTypeId
         || '. State: ' || address_stateOrRegion || '. LGA: ' || address_city
         || '. Functional status: ' || functional_status || '.') AS description,
    concat_ws(' ',
      CASE WHEN name <> '' THEN 'Facility name: ' || name || '.' END,
      CASE WHEN category <> '' THEN 'Category: ' || category || '.' END,
      CASE WHEN facilityTypeId <> '' AND facilityTypeId <> 'unknown' THEN 'Type: ' || facilityTypeId || '.' END,
      CASE WHEN functional_status <> '' THEN 'Functional status: ' || functional_status || '.' END,
      CASE WHEN operatorTypeId <> '' THEN 'Ownership: ' || operatorTypeId || '.' END,
      CASE WHEN address_city <> '' THEN 'LGA: ' || address_city || '.' END,
      CASE WHEN address_stateOrRegion <> '' THEN 'State: ' || address_stateOrRegion || '.' END,
      CASE WHEN accessibility_note <> '' THEN 'Accessibility: ' || accessibility_note || '.' END
    ) AS labelled_text,
    substr(md5(name || '|' || coalesce(CAST(latitude AS VARCHAR), 'nan') || '|'
               || coalesce(CAST(longitude AS VARCHAR), 'nan')), 1, 16) AS source_id
  FROM loaded1
),
registry AS (
  SELECT * FROM loaded2
  WHERE length(name) > 0 OR (latitude IS NOT NULL AND longitude IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY src_ord) = 1
)"""

BRONZE = f"""
bronze0 AS (
  SELECT src_ord, src_key, category, functional_status, accessibility_note,
    {sent('name')} AS name,
    {sent('address_city')} AS address_city,
    {sent('address_stateOrRegion')} AS address_stateOrRegion,
    {sent("trim(regexp_replace(" + sent('address_zipOrPostcode') + ", '\\.0$', ''))")} AS address_zipOrPostcode,
    CASE WHEN lower(trim({sent('facilityTypeId')})) IN ('farmacy','pharma','chemist') THEN 'pharmacy'
         WHEN lower(trim({sent('facilityTypeId')})) IN ('hospital','clinic','dentist','doctor','pharmacy','unknown')
           THEN lower(trim({sent('facilityTypeId')}))
         ELSE 'unknown' END AS facilityTypeId,
    {sent('operatorTypeId')} AS operatorTypeId,
    {sent('description')} AS description,
    {sent('capability')} AS specialties,
    {sent('capability')} AS capability,
    latitude, longitude,
    CAST(NULL AS BIGINT) AS numberDoctors
  FROM registry
),
bronze1 AS (
  SELECT *,
    sha256(coalesce(lower(trim(name)), '') || '|' || coalesce(lower(trim(address_city)), '') || '|'
           || coalesce(lower(trim(address_zipOrPostcode)), '')) AS facility_id,
    concat_ws(' | ', nullif(trim(name), ''), nullif(trim(description), ''), nullif(trim(specialties), ''),
              nullif(trim(capability), '')) AS composite_text
  FROM bronze0
),
bronze AS (
  SELECT *, CAST(length(composite_text) AS BIGINT) AS composite_text_length
  FROM bronze1
  QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY src_ord) = 1
)"""

EXTRACT = f"""
ex0 AS (
  SELECT *, lower(coalesce(category, '')) AS cat, lower(coalesce(functional_status, '')) AS func
  FROM bronze
),
ex1 AS (
  SELECT *,
    (contains(cat, 'teaching') OR contains(cat, 'federal medical')) AS is_t,
    contains(cat, 'specialist') AS is_sp,
    contains(cat, 'general hospital') AS is_g,
    contains(cat, 'district hospital') AS is_dh,
    contains(cat, 'cottage') AS is_c,
    contains(cat, 'comprehensive') AS is_co,
    contains(cat, 'medical center') AS is_m,
    contains(cat, 'maternity') AS is_mat,
    (contains(cat, 'dispensary') OR contains(cat, 'primary')) AS is_pri,
    CASE WHEN func IN ('functional', '') THEN 'functional' ELSE 'unknown' END AS fn
  FROM ex0
),
extracted AS (
  SELECT *,
    CASE WHEN is_t THEN 'confirmed' WHEN is_sp OR is_g OR is_dh THEN 'claimed'
         WHEN is_c OR is_co OR is_m THEN 'uncertain' ELSE 'not_present' END AS icu_present,
    CASE WHEN is_t OR is_sp OR is_g OR is_dh THEN fn ELSE 'unknown' END AS icu_functional,
    CASE WHEN is_t THEN 20 END AS icu_beds,
    CASE WHEN is_t THEN 'claimed' WHEN is_sp OR is_g OR is_dh OR is_c OR is_co OR is_m THEN 'uncertain'
         ELSE 'not_present' END AS icu_neonatal,
    CASE WHEN is_t THEN 'Category: ' || coalesce(category, '')
         WHEN is_sp OR is_g OR is_dh OR is_c OR is_co OR is_m THEN 'Category: ' || coalesce(category, '')
         ELSE '' END AS icu_source,
    CASE WHEN is_t THEN 'confirmed' WHEN is_sp OR is_g THEN 'claimed' ELSE 'uncertain' END AS vent_present,
    CASE WHEN is_t THEN 5 END AS vent_count,
    CASE WHEN is_t THEN 'full_time' WHEN is_sp THEN 'on_call' WHEN is_g OR is_dh OR is_c THEN 'on_call'
         ELSE 'unknown' END AS anest,
    CASE WHEN is_t THEN 'full_time' WHEN is_sp THEN 'full_time' WHEN is_g OR is_dh OR is_c THEN 'on_call'
         ELSE 'unknown' END AS surgeon,
    CASE WHEN is_t OR is_sp OR is_g OR is_dh OR is_c OR is_co OR is_m THEN 'full_time'
         WHEN is_mat THEN 'on_call' ELSE 'unknown' END AS gp,
    CASE WHEN is_t THEN 5 WHEN is_sp THEN 2 WHEN is_g OR is_dh OR is_c THEN 1 WHEN is_co OR is_m THEN 0
         WHEN is_mat THEN 2 ELSE 0 END AS n_spec_types,
    CASE WHEN is_t THEN 50 WHEN is_sp THEN 15 WHEN is_g OR is_dh OR is_c THEN 5 WHEN is_co OR is_m THEN 2
         WHEN is_mat THEN 2 END AS total_doctors,
    CASE WHEN is_t OR is_sp THEN 'confirmed' WHEN is_g OR is_dh OR is_c OR is_co THEN 'claimed'
         WHEN is_mat THEN 'claimed' ELSE 'uncertain' END AS em_care,
    (is_t OR is_sp) AS em_24_7,
    CASE WHEN is_t OR is_sp THEN 'confirmed' WHEN is_g OR is_dh OR is_c OR is_co THEN 'uncertain'
         ELSE 'not_present' END AS ambulance,
    CASE WHEN is_t OR is_sp THEN 'claimed' WHEN is_g OR is_dh OR is_c OR is_co THEN 'uncertain'
         ELSE 'not_present' END AS trauma,
    CASE WHEN is_t OR is_sp THEN 'confirmed' WHEN is_g OR is_dh OR is_c THEN 'claimed'
         WHEN is_mat OR is_co THEN 'uncertain' ELSE 'not_present' END AS sg_general,
    CASE WHEN is_t OR is_sp THEN 'confirmed' WHEN is_g OR is_dh OR is_c THEN 'claimed'
         ELSE 'not_present' END AS sg_append,
    CASE WHEN is_t OR is_sp THEN 'confirmed' WHEN is_g OR is_dh OR is_c THEN 'claimed'
         WHEN is_mat THEN 'confirmed' WHEN is_co THEN 'claimed' ELSE 'not_present' END AS sg_caes,
    CASE WHEN is_t OR is_sp THEN 'claimed' WHEN is_g OR is_dh OR is_c THEN 'uncertain'
         ELSE 'not_present' END AS sg_ortho,
    CASE WHEN is_t THEN 'claimed' WHEN is_sp THEN 'uncertain' ELSE 'not_present' END AS sg_cardiac,
    CASE WHEN is_t THEN 'confirmed' WHEN is_sp THEN 'claimed' ELSE 'not_present' END AS dial_present,
    CASE WHEN is_t THEN 4 END AS dial_machines,
    CASE WHEN is_t THEN ['Surgery', 'Internal Medicine', 'Obstetrics & Gynaecology', 'Paediatrics',
                         'Anaesthesiology', 'Radiology', 'Pathology']
         WHEN is_sp THEN ['Specialist care', 'Surgery']
         WHEN is_mat THEN ['Obstetrics', 'Midwifery', 'Postnatal care']
         WHEN is_g OR is_dh OR is_c THEN ['General Medicine', 'Surgery', 'Maternity']
         WHEN is_pri THEN ['Primary care', 'Immunisation', 'Antenatal']
         ELSE CAST([] AS VARCHAR[]) END AS specialties_list,
    'Category: ' || coalesce(category, '') || '. Functional: ' || coalesce(functional_status, '') || '.' AS raw_text_used,
    CASE WHEN lower(coalesce(facilityTypeId, '')) IN ('farmacy','pharma','chemist') THEN 'pharmacy'
         WHEN lower(trim(facilityTypeId)) IN ('hospital','clinic','dentist','doctor','pharmacy','unknown')
           THEN lower(trim(facilityTypeId)) ELSE 'unknown' END AS facility_type,
    CASE WHEN func = 'not functional' THEN 0 ELSE coalesce(composite_text_length, 60) END AS ctl
  FROM ex1
)"""

RULES = f"""
ruled0 AS (
  SELECT *,
    (sg_general IN {P} AND anest = 'unknown') AS r1,
    (icu_present IN {P} AND icu_functional = 'non_functional') AS r2,
    (icu_present = 'confirmed' AND coalesce(icu_beds, 0) = 0) AS r3,
    (em_24_7 AND em_care IN {P} AND gp NOT IN {RS} AND surgeon NOT IN {RS}) AS r4,
    (sg_cardiac IN {P} AND facility_type <> 'hospital') AS r5,
    ((total_doctors IS NULL OR total_doctors <= 1) AND n_spec_types > 3) AS r6,
    (vent_present IN {P} AND icu_present = 'not_present') AS r7,
    (sg_caes IN {P} AND anest = 'unknown') AS r8,
    (CAST(icu_present IN {DA} AS INTEGER) + CAST(vent_present IN {DA} AS INTEGER)
     + CAST(anest IN {DS} AS INTEGER) + CAST(em_care IN {DA} AS INTEGER)
     + CAST(sg_general IN {DA} AS INTEGER) + CAST(dial_present IN {DA} AS INTEGER)) AS det
  FROM extracted
),
ruled AS (
  SELECT *, det < 3 AS r9, ctl < 60 AS r10 FROM ruled0
),
scored AS (
  SELECT *,
    {rd(f'''greatest({dbl(0.05)}, least({dbl(1.0)},
      {dbl(1.0)} * (CASE WHEN r1 THEN {dbl(0.7)} ELSE {dbl(1.0)} END)
      * (CASE WHEN r2 THEN {dbl(0.8)} ELSE {dbl(1.0)} END)
      * (CASE WHEN r3 THEN {dbl(0.9)} ELSE {dbl(1.0)} END)
      * (CASE WHEN r4 THEN {dbl(0.8)} ELSE {dbl(1.0)} END)
      * (CASE WHEN r5 THEN {dbl(0.8)} ELSE {dbl(1.0)} END)
      * (CASE WHEN r6 THEN {dbl(0.85)} ELSE {dbl(1.0)} END)
      * (CASE WHEN r7 THEN {dbl(0.9)} ELSE {dbl(1.0)} END)
      * (CASE WHEN r8 THEN {dbl(0.75)} ELSE {dbl(1.0)} END)
      * (CASE WHEN r9 THEN {dbl(0.9)} ELSE {dbl(1.0)} END)
      * (CASE WHEN r10 THEN {dbl(0.95)} ELSE {dbl(1.0)} END)))''', 3)} AS base_trust,
    CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER) + CAST(r4 AS INTEGER) + CAST(r5 AS INTEGER)
      + CAST(r8 AS INTEGER) AS n_high,
    CAST(r3 AS INTEGER) + CAST(r6 AS INTEGER) + CAST(r7 AS INTEGER) AS n_med,
    CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER) + CAST(r3 AS INTEGER) + CAST(r4 AS INTEGER)
      + CAST(r5 AS INTEGER) + CAST(r6 AS INTEGER) + CAST(r7 AS INTEGER) + CAST(r8 AS INTEGER)
      + CAST(r9 AS INTEGER) + CAST(r10 AS INTEGER) AS n_flags,
    concat_ws(',',
      CASE WHEN r1 THEN 'SURGERY_NO_ANESTHESIOLOGIST' END, CASE WHEN r2 THEN 'ICU_NON_FUNCTIONAL' END,
      CASE WHEN r3 THEN 'ICU_CONFIRMED_NO_BEDS' END, CASE WHEN r4 THEN '24_7_NO_STAFF' END,
      CASE WHEN r5 THEN 'CARDIAC_SURGERY_LOW_TIER' END, CASE WHEN r6 THEN 'NO_DOCTORS_MANY_SPECIALTIES' END,
      CASE WHEN r7 THEN 'VENTILATOR_NO_ICU' END, CASE WHEN r8 THEN 'CAESAREAN_NO_ANESTHESIOLOGIST' END,
      CASE WHEN r9 THEN 'MISSING_CRITICAL_FIELDS' END, CASE WHEN r10 THEN 'EMPTY_DESCRIPTION' END
    ) AS flag_types,
    concat_ws(' ; ',
      CASE WHEN r1 THEN 'surgery.general_surgery=' || sg_general || ', staff.anesthesiologist=unknown' END,
      CASE WHEN r2 THEN 'icu.present=' || icu_present || ', functional=' || icu_functional END,
      CASE WHEN r3 THEN 'ICU confirmed but bed_count missing/zero' END,
      CASE WHEN r4 THEN 'is_24_7=True, gp=' || gp || ', surgeon=' || surgeon END,
      CASE WHEN r5 THEN 'surgery.cardiac=' || sg_cardiac || ', facility_type=' || facility_type END,
      CASE WHEN r6 THEN 'total_doctors=' || coalesce(CAST(total_doctors AS VARCHAR), 'None')
                        || ', specialties=' || CAST(n_spec_types AS VARCHAR) END,
      CASE WHEN r7 THEN 'ventilator=' || vent_present || ', icu=' || icu_present END,
      CASE WHEN r8 THEN 'caesarean=' || sg_caes || ', anest=unknown' END,
      CASE WHEN r9 THEN 'determined=' || CAST(det AS VARCHAR) || '/6' END,
      CASE WHEN r10 THEN 'composite_text_length=' || CAST(ctl AS VARCHAR) END
    ) AS flag_evidence
  FROM ruled
)"""

GOLD = f"""
adjusted AS (
  SELECT *,
    {rd(f'''CASE WHEN func = 'not functional' THEN greatest({dbl(0.05)}, boosted * {dbl(0.40)})
         WHEN func = 'partially functional' THEN greatest({dbl(0.05)}, boosted * {dbl(0.70)})
         ELSE boosted END''', 3)} AS trust_score
  FROM (
    SELECT *,
      CASE WHEN is_t THEN least({dbl(1.0)}, base_trust * {dbl(1.25)})
           WHEN is_sp THEN least({dbl(1.0)}, base_trust * {dbl(1.10)})
           ELSE base_trust END AS boosted
    FROM scored
  )
),
conf0 AS (
  SELECT *,
    CAST(det AS DOUBLE) / {dbl(6.0)} AS completeness_raw,
    greatest({dbl(0.0)}, {dbl(1.0)} - CAST(n_high AS DOUBLE) * {dbl(0.25)} - CAST(n_med AS DOUBLE) * {dbl(0.10)}) AS consistency_raw,
    CASE WHEN ctl > 1000 THEN {dbl(0.85)} WHEN ctl > 400 THEN {dbl(0.65)} WHEN ctl > 100 THEN {dbl(0.45)}
         ELSE {dbl(0.20)} END AS reliability_raw,
    {dbl(0.05)} + least({dbl(0.20)}, CAST(n_flags AS DOUBLE) * {dbl(0.02)}) AS noise
  FROM adjusted
),
conf1 AS (
  SELECT *,
    {rd(f'{dbl(0.40)} * completeness_raw + {dbl(0.35)} * consistency_raw + {dbl(0.25)} * reliability_raw', 3)} AS conf_overall
  FROM conf0
),
gold AS (
  SELECT facility_id, src_key,
    coalesce(nullif(trim(name), ''), '') AS name,
    nullif(trim(address_city), '') AS address_city,
    nullif(trim(address_stateOrRegion), '') AS address_state,
    nullif(trim(address_zipOrPostcode), '') AS address_zip,
    latitude, longitude, facility_type,
    nullif(trim(operatorTypeId), '') AS operator_type,
    nullif(trim(category), '') AS category,
    nullif(trim(functional_status), '') AS functional_status,
    nullif(trim(accessibility_note), '') AS accessibility_note,
    icu_present, icu_functional, icu_beds, icu_neonatal, icu_source, vent_present, vent_count,
    anest, surgeon, gp, n_spec_types, total_doctors, em_care, em_24_7, ambulance, trauma,
    sg_general, sg_append, sg_caes, sg_ortho, sg_cardiac, dial_present, dial_machines, specialties_list,
    raw_text_used, trust_score, flag_types, flag_evidence, n_flags, n_high,
    {rd('completeness_raw', 3)} AS conf_completeness,
    {rd('consistency_raw', 3)} AS conf_consistency,
    {rd('reliability_raw', 3)} AS conf_reliability,
    conf_overall,
    {rd(f'greatest({dbl(0.0)}, conf_overall - noise)', 3)} AS conf_low,
    {rd(f'least({dbl(1.0)}, conf_overall + noise)', 3)} AS conf_high,
    substr(concat_ws(' ',
      'Facility: ' || coalesce(name, '') || '.',
      'Location: ' || coalesce(nullif(trim(address_city), ''), 'Unknown city') || ', '
        || coalesce(nullif(trim(address_stateOrRegion), ''), 'Unknown state') || ', PIN '
        || coalesce(nullif(trim(address_zipOrPostcode), ''), 'unknown') || '.',
      'Type: ' || facility_type || '.',
      'Specialties: ' || CASE WHEN len(specialties_list) > 0 THEN array_to_string(specialties_list[1:20], ', ')
                              ELSE 'none extracted' END || '.',
      'ICU: ' || icu_present || '. Emergency: ' || em_care || '. Surgery: ' || sg_general || '.',
      'Trust score: ' || CAST(trust_score AS VARCHAR) || '.',
      nullif(substr(raw_text_used, 1, 300), '')
    ), 1, 2000) AS embedding_text
  FROM conf1
)"""

DESERTS = f"""
area AS (
  SELECT address_zip AS pin_code, address_state AS state,
    CAST(count(*) AS BIGINT) AS facility_count,
    avg(trust_score) AS avg_trust_score,
    avg(CAST(icu_present IN {P} AS INTEGER)) AS icu_coverage,
    avg(CAST(dial_present IN {P} AS INTEGER)) AS dialysis_coverage,
    avg(CAST(em_care IN {P} AS INTEGER)) AS emergency_coverage,
    avg(CAST(sg_general IN {P} AS INTEGER)) AS surgery_coverage,
    avg(latitude) AS centroid_lat, avg(longitude) AS centroid_lon
  FROM gold
  WHERE address_zip IS NOT NULL AND length(trim(address_zip)) > 0
  GROUP BY address_zip, address_state
),
deserts AS (
  SELECT *,
    {rd(f'''{dbl(0.35)} * ({dbl(1.0)} - icu_coverage) + {dbl(0.30)} * ({dbl(1.0)} - emergency_coverage)
         + {dbl(0.20)} * ({dbl(1.0)} - dialysis_coverage) + {dbl(0.15)} * ({dbl(1.0)} - surgery_coverage)''', 3)}
      AS desert_risk_score,
    CASE WHEN icu_coverage >= 0.1 AND dialysis_coverage >= 0.1 AND emergency_coverage >= 0.1
              AND surgery_coverage >= 0.1 THEN 'ADEQUATE_COVERAGE'
         ELSE concat_ws(',', CASE WHEN icu_coverage < 0.1 THEN 'ICU_DESERT' END,
                        CASE WHEN dialysis_coverage < 0.1 THEN 'DIALYSIS_DESERT' END,
                        CASE WHEN emergency_coverage < 0.1 THEN 'EMERGENCY_DESERT' END,
                        CASE WHEN surgery_coverage < 0.1 THEN 'SURGERY_DESERT' END) END AS desert_categories
  FROM area
)"""


def with_ctes(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip("\n") for b in blocks)


CHAIN_REGISTRY = (RAW, LOADED)
CHAIN_BRONZE = (RAW, LOADED, BRONZE)
CHAIN_GOLD = (RAW, LOADED, BRONZE, EXTRACT, RULES, GOLD)
CHAIN_DESERTS = CHAIN_GOLD + (DESERTS,)


# ---------------------------------------------------------------------------
# Geo (brute force: every request x every facility, exact filter)
# ---------------------------------------------------------------------------

def _cap_sql() -> str:
    def add(*terms):
        return "(" + dbl(0.0) + "".join(f" + {t}" for t in terms) + ")"

    def iff(cond, v):
        return f"(CASE WHEN coalesce({cond}, false) THEN {dbl(v)} ELSE {dbl(0.0)} END)"

    def clamp(x):
        return rd(f"least({dbl(1.0)}, greatest({dbl(0.0)}, {x}))", 3)

    spec = lambda needles: ("(len(list_filter(specialties_list, lambda s: "
                            + " OR ".join(f"contains(lower(s), '{n}')" for n in needles) + ")) > 0)")
    return ",\n    ".join([
        clamp(add(iff(f"em_care IN {P}", 0.5), iff("em_24_7", 0.3), iff(f"ambulance IN {P}", 0.2))) + " AS cap_emergency",
        clamp(add(f"(CASE WHEN icu_present = 'confirmed' THEN {dbl(0.6)} WHEN icu_present = 'claimed' THEN {dbl(0.35)} ELSE {dbl(0.0)} END)",
                  iff("icu_functional = 'functional'", 0.3), iff("icu_beds > 0", 0.1))) + " AS cap_icu",
        clamp(add(iff(f"sg_caes IN {P}", 0.6), iff(f"em_care IN {P}", 0.2), iff(spec(("mat", "obstet", "gyn")), 0.2))) + " AS cap_maternity",
        clamp(add(iff(f"sg_general IN {P}", 0.5), iff(f"anest IN {RS}", 0.3), iff(f"surgeon IN {RS}", 0.2))) + " AS cap_surgery",
        clamp(add(f"(CASE WHEN dial_present = 'confirmed' THEN {dbl(0.7)} WHEN dial_present = 'claimed' THEN {dbl(0.4)} ELSE {dbl(0.0)} END)",
                  iff("dial_machines > 0", 0.3))) + " AS cap_dialysis",
        clamp(add(iff(spec(("paed", "pedi", "child")), 0.7), iff(f"icu_neonatal IN {P}", 0.3))) + " AS cap_pediatric",
        clamp(add(iff(f"em_care IN {P}", 0.5), iff(f"gp IN {RS}", 0.5))) + " AS cap_general",
    ])


CANDIDATES = f"""
cand AS (
  SELECT facility_id, name, latitude, longitude, trust_score, facility_type, category, functional_status,
    coalesce(lower(functional_status), '') AS func_l,
    {_cap_sql()},
    array_to_string((list_filter([
        CASE WHEN em_care IN {P} THEN 'Emergency Care' END,
        CASE WHEN em_24_7 THEN '24/7 Service' END,
        CASE WHEN ambulance IN {P} THEN 'Ambulance' END,
        CASE WHEN icu_present IN {P} THEN 'ICU (' || CASE WHEN coalesce(icu_beds, 0) <> 0 THEN CAST(icu_beds AS VARCHAR) ELSE '?' END || ' beds)' END,
        CASE WHEN sg_general IN {P} THEN 'Surgery' END,
        CASE WHEN sg_caes IN {P} THEN 'Maternity / C-Section' END,
        CASE WHEN dial_present IN {P} THEN 'Dialysis' END,
        CASE WHEN anest IN {RS} THEN 'Anesthesiologist on staff' END], lambda x: x IS NOT NULL)
      || specialties_list[1:3])[1:6], '; ') AS matched_capabilities
  FROM gold WHERE latitude IS NOT NULL AND longitude IS NOT NULL
)"""

REQUESTS = f"""
req AS (
  SELECT event_id AS request_id,
    {dbl(4.0)} + CAST((event_id * 7907) % 10000 AS DOUBLE) / {dbl(1000.0)} AS lat,
    {dbl(3.0)} + CAST((event_id * 10459) % 11000 AS DOUBLE) / {dbl(1000.0)} AS lon,
    CASE event_id % 7 WHEN 0 THEN 'emergency' WHEN 1 THEN 'icu' WHEN 2 THEN 'maternity' WHEN 3 THEN 'surgery'
         WHEN 4 THEN 'dialysis' WHEN 5 THEN 'pediatric' ELSE 'general' END AS need_type,
    5 AS top_k,
    {dbl(10.0)} + CAST(event_id % 3 AS DOUBLE) * {dbl(20.0)} AS radius_km,
    CASE WHEN event_id % 5 = 0 THEN {dbl(0.5)} ELSE {dbl(0.0)} END AS min_trust_score,
    (event_id % 4 = 0) AS functional_only
  FROM events
)"""


def hav_sql(lat1, lon1, lat2, lon2) -> str:
    a = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"{dbl(12742.0)} * asin(sqrt(least({dbl(1.0)}, {a})))"


def ranked_sql(req_cte: str, name: str) -> str:
    """CTEs '<name>_pairs', '<name>_scored', '<name>_all' and '<name>' (top_k per request)."""
    return f"""
{name}_pairs AS (
  SELECT r.request_id, r.need_type, r.top_k, r.radius_km, c.*,
    {rd(hav_sql('r.lat', 'r.lon', 'c.latitude', 'c.longitude'), 2)} AS distance_km
  FROM {req_cte} r, cand c
  WHERE (NOT r.functional_only OR c.func_l IN ('functional', ''))
    AND (r.min_trust_score <= 0 OR c.trust_score >= r.min_trust_score)
),
{name}_scored AS (
  SELECT *,
    {rd(f"{dbl(0.35)} * exp(-distance_km / {dbl(15.0)}) + {dbl(0.35)} * coalesce(trust_score, 0.0) + {dbl(0.30)} * cap_score", 4)} AS composite_score
  FROM (
    SELECT *,
      CASE need_type WHEN 'emergency' THEN cap_emergency WHEN 'icu' THEN cap_icu WHEN 'maternity' THEN cap_maternity
        WHEN 'surgery' THEN cap_surgery WHEN 'dialysis' THEN cap_dialysis WHEN 'pediatric' THEN cap_pediatric
        ELSE cap_general END AS cap_score
    FROM {name}_pairs WHERE distance_km <= radius_km
  )
),
{name}_all AS (
  SELECT request_id, facility_id, coalesce(nullif(name, ''), facility_id) AS facility_name, composite_score,
    distance_km, CAST({rd(f'distance_km / {dbl(30.0)} * {dbl(60.0)}', 0)} AS INTEGER) AS estimated_travel_min,
    coalesce(trust_score, 0.0) AS trust_score,
    CASE WHEN trust_score >= 0.85 THEN 'A' WHEN trust_score >= 0.70 THEN 'B' WHEN trust_score >= 0.55 THEN 'C'
         WHEN trust_score >= 0.40 THEN 'D' ELSE 'F' END AS trust_grade,
    cap_score, matched_capabilities, top_k,
    CAST(row_number() OVER (PARTITION BY request_id ORDER BY composite_score DESC, facility_id) AS INTEGER) AS rank
  FROM {name}_scored
),
{name} AS (SELECT * FROM {name}_all WHERE rank <= top_k)"""


CHAIN_GEO = CHAIN_GOLD + (CANDIDATES, REQUESTS)


# ---------------------------------------------------------------------------
# Vector search (brute force over every query x corpus pair)
# ---------------------------------------------------------------------------

VECTORS = f"""
vt AS (
  SELECT g.facility_id, g.name, g.address_state, g.address_city, g.address_zip, g.facility_type, g.trust_score,
    CAST(e.embedding AS DOUBLE[]) AS emb
  FROM gold g JOIN embeddings e ON g.src_key = e.vec_id
),
vq AS (
  SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS qv,
    CASE label % 8 WHEN 0 THEN 'Need an ICU bed with ventilator support'
      WHEN 1 THEN 'emergency c-section for my wife' WHEN 2 THEN 'kidney dialysis centre near me'
      WHEN 3 THEN '24/7 casualty for a road accident' WHEN 4 THEN 'child fever, looking for a paediatric doctor'
      WHEN 5 THEN 'dental clinic for tooth pain' WHEN 6 THEN 'heart surgery hospital'
      ELSE 'general checkup' END AS query,
    CASE WHEN label < 2 THEN CASE vec_id % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA'
      WHEN 3 THEN 'EUROPE' WHEN 4 THEN 'MIDDLE EAST' END END AS state,
    CAST(NULL AS VARCHAR) AS city,
    CASE WHEN label = 9 THEN 'hospital' END AS facility_type,
    CASE WHEN label = 3 THEN {dbl(0.0)} END AS min_trust_score
  FROM embeddings
),
sims AS (
  SELECT q.query_id, q.state AS q_state, q.city AS q_city, q.facility_type AS q_type, q.min_trust_score AS q_min,
    v.facility_id, v.address_state, v.address_city, v.facility_type, v.trust_score,
    {rd('list_dot_product(q.qv, v.emb)', 6)} AS similarity
  FROM vq q, vt v
),
sims_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, facility_id) AS sim_rank FROM sims
),
sims_ok AS (
  SELECT * FROM sims_ranked
  WHERE (q_state IS NULL OR lower(coalesce(address_state, '')) = lower(q_state))
    AND (q_city IS NULL OR lower(coalesce(address_city, '')) = lower(q_city))
    AND (q_type IS NULL OR lower(coalesce(facility_type, '')) = lower(q_type))
    AND (q_min IS NULL OR coalesce(trust_score, 0.0) >= q_min)
)"""


def postfilter_sql(k: int, name: str = "hits", min_default: str | None = None) -> str:
    """Over-fetch min(N, 4k) by similarity, filter, first k (retrieval_rank)."""
    extra = "" if min_default is None else f" AND coalesce(trust_score, 0.0) >= coalesce(q_min, {min_default})"
    return f"""
{name} AS (
  SELECT query_id, facility_id, similarity,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim_rank) AS INTEGER) AS retrieval_rank
  FROM sims_ok
  WHERE sim_rank <= least((SELECT count(*) FROM vt), {4 * k}){extra}
  QUALIFY retrieval_rank <= {k}
)"""


def prefilter_sql(k: int, name: str = "hits", min_default: str | None = None) -> str:
    """The first k (retrieval_rank) of all rows that pass the filters."""
    extra = "" if min_default is None else f" WHERE coalesce(trust_score, 0.0) >= coalesce(q_min, {min_default})"
    return f"""
{name} AS (
  SELECT query_id, facility_id, similarity,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim_rank) AS INTEGER) AS retrieval_rank
  FROM sims_ok{extra} QUALIFY retrieval_rank <= {k}
)"""


CHAIN_VECTOR = CHAIN_GOLD + (VECTORS,)


# ---------------------------------------------------------------------------
# Intents and the deterministic ranker
# ---------------------------------------------------------------------------

INTENT_KEYWORDS_SQL = (
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


def intents_sql(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    items = []
    for tag, kws in INTENT_KEYWORDS_SQL:
        cond = " OR ".join(f"contains({t}, '{k}')" for k in kws)
        items.append(f"CASE WHEN {cond} THEN '{tag}' END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def _pres(c: str) -> str:
    return f"coalesce(lower({c}) IN {P}, false)"


MATCHED_SQL = f"""CASE i
  WHEN 'icu' THEN {_pres('icu_present')}
  WHEN 'ventilator' THEN {_pres('vent_present')}
  WHEN 'dialysis' THEN {_pres('dial_present')}
  WHEN 'emergency' THEN {_pres('em_care')}
  WHEN 'trauma' THEN {_pres('trauma')}
  WHEN 'surgery' THEN ({_pres('sg_general')} OR {_pres('sg_append')} OR {_pres('sg_caes')} OR {_pres('sg_ortho')} OR {_pres('sg_cardiac')})
  WHEN 'ambulance' THEN {_pres('ambulance')}
  ELSE (i IN ('maternity','cardiac','orthopedic','neonatal','dentist','pharmacy') AND (
        len(list_filter(specialties_list, lambda s: contains(lower(s), i))) > 0
        OR (i = 'neonatal' AND {_pres('icu_neonatal')})
        OR (i = 'cardiac' AND {_pres('sg_cardiac')})))
END"""

EVIDENCE_SQL = f"""CASE
  WHEN i = 'icu' THEN 'ICU available' || CASE WHEN coalesce(icu_beds, 0) <> 0 THEN ' (' || CAST(icu_beds AS VARCHAR) || ' beds)' ELSE '' END
  WHEN i = 'ventilator' THEN 'Ventilator' || CASE WHEN coalesce(vent_count, 0) <> 1 THEN 's' ELSE '' END || ' on site'
       || CASE WHEN coalesce(vent_count, 0) <> 0 THEN ' (n=' || CAST(vent_count AS VARCHAR) || ')' ELSE '' END
  WHEN i = 'dialysis' THEN 'Dialysis service' || CASE WHEN coalesce(dial_machines, 0) <> 0 THEN ' (' || CAST(dial_machines AS VARCHAR) || ' machines)' ELSE '' END
  WHEN i = 'emergency' THEN CASE WHEN coalesce(em_24_7, false) THEN '24/7 emergency care' ELSE 'Emergency care available' END
  WHEN i = 'trauma' THEN 'Trauma capability'
  WHEN i = 'surgery' THEN CASE WHEN {_pres('sg_general')} THEN 'Surgery: general surgery'
       WHEN {_pres('sg_append')} THEN 'Surgery: appendectomy' WHEN {_pres('sg_caes')} THEN 'Surgery: caesarean'
       WHEN {_pres('sg_ortho')} THEN 'Surgery: orthopedic' WHEN {_pres('sg_cardiac')} THEN 'Surgery: cardiac' ELSE '' END
  WHEN i = 'ambulance' THEN 'Ambulance service'
  WHEN len(list_filter(specialties_list, lambda s: contains(lower(s), i))) > 0 THEN 'Listed specialty: ' || i
  WHEN i = 'neonatal' THEN 'Neonatal ICU'
  WHEN i = 'cardiac' THEN 'Cardiac surgery available'
  ELSE '' END"""


def fmt2(x: str) -> str:
    return f"printf('%.2f', {rd(x, 2)})"


RANKER = f"""
qint AS (SELECT query_id, min_trust_score, {intents_sql('query')} AS intents FROM vq),
rcands AS (
  SELECT h.query_id, h.facility_id, h.similarity, h.retrieval_rank, qi.intents, g.*
    EXCLUDE (facility_id)
  FROM hits h JOIN gold g ON h.facility_id = g.facility_id JOIN qint qi ON h.query_id = qi.query_id
  WHERE g.trust_score >= coalesce(qi.min_trust_score, {dbl(0.4)})
),
rm0 AS (SELECT *, list_filter(intents, lambda i: {MATCHED_SQL}) AS matched FROM rcands),
rm1 AS (
  SELECT *,
    list_filter(list_transform(matched, lambda i: {EVIDENCE_SQL}), lambda e: e <> '') AS evidence,
    least({dbl(1.0)}, greatest({dbl(0.0)}, similarity)) AS sim,
    {rd('coalesce(trust_score, 0.0)', 3)} AS trust,
    CASE WHEN len(intents) > 0 THEN CAST(len(matched) AS DOUBLE) / CAST(len(intents) AS DOUBLE) ELSE {dbl(0.5)} END AS cov
  FROM rm0
),
rscored AS (SELECT *, {dbl(0.55)} * sim + {dbl(0.30)} * trust + {dbl(0.15)} * cov AS score FROM rm1),
ranked_all AS (
  SELECT query_id, facility_id, retrieval_rank, coalesce(nullif(name, ''), 'Unknown facility') AS facility_name,
    {rd(f'least({dbl(1.0)}, greatest({dbl(0.0)}, score))', 4)} AS suitability_score,
    CASE WHEN len(evidence) > 0 THEN 'Top match for your query — ' || coalesce(nullif(name, ''), 'facility')
           || ' reports: ' || array_to_string(evidence[1:4], '; ') || '. Trust score ' || {fmt2('trust')}
           || ' based on data completeness and consistency checks.'
         WHEN len(intents) > 0 THEN 'Closest semantic match by description (similarity ' || {fmt2('sim')}
           || '); however, the facility''s structured records do not explicitly confirm '
           || array_to_string(intents, ', ') || '. Verify by phone before travel. Trust score ' || {fmt2('trust')} || '.'
         ELSE 'Closest semantic match (similarity ' || {fmt2('sim')} || '). Trust score ' || {fmt2('trust')} || '.'
    END AS reasoning,
    array_to_string(matched, ',') AS matched_capabilities, array_to_string(evidence, '; ') AS evidence_text,
    CASE WHEN len(matched) = 0 THEN array_to_string(list_transform(intents, lambda i: 'No clear evidence of ' || i), '; ')
         ELSE '' END AS warnings,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_rank) AS INTEGER) AS rank,
    address_city, address_state, trust_score
  FROM rscored
),
ranked AS (SELECT * FROM ranked_all WHERE rank <= 5)"""

CHAIN_RANK = CHAIN_VECTOR + (prefilter_sql(20, "hits", min_default=dbl(0.4)), RANKER)


# ---------------------------------------------------------------------------
# Model replies: unfence + relaxed validation (subset of fields)
# ---------------------------------------------------------------------------

def _jt(path: str) -> str:
    return f"json_type(json_extract(jbody, '{path}'))"


def _int_sql(path: str) -> str:
    t = _jt(path)
    s = f"trim(json_extract_string(jbody, '{path}'))"
    d = (f"CASE WHEN {t} IN ('BIGINT','UBIGINT','DOUBLE','INTEGER') THEN TRY_CAST(json_extract_string(jbody, '{path}') AS DOUBLE) "
         f"WHEN {t} = 'VARCHAR' THEN CASE WHEN lower({s}) IN ('null','none','n/a','nan','') THEN NULL "
         f"ELSE TRY_CAST({s} AS DOUBLE) END END")
    return f"CAST(trunc({d}) AS INTEGER)"


def _enum_sql(path: str, default: str) -> str:
    return (f"CASE WHEN json_extract(jbody, '{path}') IS NULL THEN '{default}' "
            f"WHEN {_jt(path)} = 'VARCHAR' THEN json_extract_string(jbody, '{path}') END")


def _list_sql(path: str, comma: bool) -> str:
    s = f"trim(json_extract_string(jbody, '{path}'))"
    items = lambda expr: (f"list_filter(list_transform({expr}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), "  # noqa: E731
                          f"lambda x: x <> '')")
    text_case = (f"CASE WHEN {s} = '' THEN CAST([] AS VARCHAR[]) "
                 f"WHEN json_valid({s}) AND json_type({s}) = 'ARRAY' THEN {items(f'json_extract_string({s}, ' + chr(39) + '$[*]' + chr(39) + ')')} "
                 f"WHEN json_valid({s}) THEN CAST([] AS VARCHAR[]) "
                 + (f"ELSE {items(f'string_split({s}, ' + chr(39) + ',' + chr(39) + ')')} END" if comma
                    else "ELSE CAST([] AS VARCHAR[]) END"))
    return (f"CASE WHEN {_jt(path)} = 'ARRAY' THEN {items(f'json_extract_string(jbody, ' + chr(39) + path + '[*]' + chr(39) + ')')} "
            f"WHEN {_jt(path)} = 'VARCHAR' THEN {text_case} ELSE CAST([] AS VARCHAR[]) END")


REPLIES = f"""
replies0 AS (
  SELECT event_id, sha256('fac-' || CAST(event_id AS VARCHAR)) AS facility_id,
    CAST(json_extract(props, '$.k') AS VARCHAR) AS n, event_type
  FROM events
),
replies1 AS (
  SELECT event_id, facility_id,
    CASE event_id % 8
      WHEN 0 THEN '{{"icu":{{"present":"claimed","bed_count":' || n || '}},"staff":{{"specialist_types":["Surgery","Paediatrics"],"total_doctor_count":"' || n || '"}},"facility_id":"other"}}'
      WHEN 1 THEN '```json' || chr(10) || '{{"icu":{{"present":"claimed","bed_count":' || n || '}},"staff":{{"specialist_types":["Surgery","Paediatrics"],"total_doctor_count":"' || n || '"}},"facility_id":"other"}}' || chr(10) || '```'
      WHEN 2 THEN '{{"icu":{{"present":"definitely_yes"}},"note":"' || event_type || '"}}'
      WHEN 3 THEN '{{"dialysis":{{"present":"confirmed","machine_count":"' || n || '.7"}},"emergency":{{"is_24_7":true,"emergency_care":"claimed"}}}}'
      WHEN 4 THEN '{{"icu": {{"present": "claimed"' || n
      WHEN 5 THEN '{{"staff":{{"specialist_types":"cardiology, oncology, , urology"}},"specialties_extracted":"[\\"x\\", \\" y \\"]","ventilator":{{"count":"nan"}}}}'
      WHEN 6 THEN 'Here you go:' || chr(10) || '```json' || chr(10) || '{{"icu":{{"present":"claimed","bed_count":' || n || '}},"staff":{{"specialist_types":["Surgery","Paediatrics"],"total_doctor_count":"' || n || '"}},"facility_id":"other"}}' || chr(10) || '```'
      ELSE '[' || n || ']' END AS raw_response
  FROM replies0
),
replies2 AS (
  SELECT *, regexp_replace(raw_response, '^\\s+|\\s+$', '', 'g') AS c FROM replies1
),
replies3 AS (
  SELECT *, regexp_extract(c, '(?s)^```(.*?)(?:```|$)', 1) AS inner_txt FROM replies2
),
parsed AS (
  SELECT event_id, facility_id, raw_response,
    CASE WHEN starts_with(c, '```') THEN regexp_replace(
      CASE WHEN starts_with(lower(regexp_replace(inner_txt, '^\\s+', '')), 'json')
           THEN CASE WHEN contains(inner_txt, chr(10)) THEN regexp_replace(inner_txt, '^[^\\n]*\\n', '') ELSE '' END
           ELSE inner_txt END, '^\\s+|\\s+$', '', 'g')
    ELSE c END AS body
  FROM replies3
),
parsed_j AS (
  SELECT *, CASE WHEN json_valid(body) THEN body END AS jbody FROM parsed
),
validated AS (
  SELECT event_id, facility_id, body,
    CASE WHEN NOT json_valid(body) THEN 'invalid JSON'
         WHEN json_type(jbody) <> 'OBJECT' THEN 'JSON is not an object'
         WHEN NOT coalesce({_enum_sql('$.icu.present', 'uncertain')} IN ('confirmed','claimed','not_present','uncertain'), false)
           THEN 'icu.present: invalid value'
    END AS error,
    {_enum_sql('$.icu.present', 'uncertain')} AS icu_present,
    {_int_sql('$.icu.bed_count')} AS icu_beds,
    {_int_sql('$.staff.total_doctor_count')} AS total_doctors,
    {_int_sql('$.dialysis.machine_count')} AS dialysis_machines,
    {_int_sql('$.ventilator.count')} AS vent_count,
    {_enum_sql('$.dialysis.present', 'uncertain')} AS dialysis_present,
    coalesce(CAST(json_extract(jbody, '$.emergency.is_24_7') AS BOOLEAN), false) AS is_24_7,
    {_list_sql('$.staff.specialist_types', True)} AS specialist_types,
    {_list_sql('$.specialties_extracted', False)} AS specialties
  FROM parsed_j
)"""


# Rule Gold (D4): same rules over the extraction, text length without the
# heuristic path's "not functional -> 0" substitution, no category adjustments.
RULE_GOLD = ("extracted_rg AS (SELECT * REPLACE (coalesce(composite_text_length, 0) AS ctl) FROM extracted),\n"
             + RULES.strip("\n").replace("ruled0", "rg_ruled0").replace("ruled AS", "rg_ruled AS")
             .replace("FROM ruled", "FROM rg_ruled").replace("scored AS", "rg_scored AS")
             .replace("FROM extracted", "FROM extracted_rg"))
CHAIN_RULE_GOLD = CHAIN_GOLD + (RULE_GOLD,)

# Second registry split (S6): suppliers as facilities, same loader rules.
SUPPLIER_SPLIT = f"""
supplier_raw AS (
  SELECT s.s_suppkey AS k, s.s_name AS prmry_name,
    {dbl(5.0)} + CAST((s.s_suppkey * 7561) % 9000 AS DOUBLE) / {dbl(1000.0)} AS latitude,
    {dbl(4.0)} + CAST((s.s_suppkey * 6007) % 9000 AS DOUBLE) / {dbl(1000.0)} AS longitude,
    r.r_name AS statename, n.n_name AS lganame
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


# ---------------------------------------------------------------------------
# The offline stand-in model in SQL: keyword tests, JSON as Python writes it, tokens by length
# ---------------------------------------------------------------------------

def _offline_sql() -> str:
    from caregrid.operators.inference import EXTRACT_CHARS, EXTRACT_SYSTEM

    has = lambda *kws: " OR ".join(f"contains(t, '{k}')" for k in kws)
    claim = lambda *kws: f"CASE WHEN {has(*kws)} THEN 'claimed' ELSE 'uncertain' END"
    words = ("maternity", "surgery", "immunisation")
    escaped = "replace(replace(replace(raw_text_used, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"
    return f"""
llm0 AS (
  SELECT *, 'Facility id: ' || facility_id || chr(10) || 'Description:' || chr(10) || substr(composite_text, 1, {EXTRACT_CHARS}) AS user_msg
  FROM bronze WHERE length(coalesce(composite_text, '')) > 0
),
llm1 AS (
  SELECT *, {claim('icu', 'intensive')} AS l_icu, {claim('emergency')} AS l_em, contains(t, '24/7') AS l_24, {claim('surgery')} AS l_sg,
    {claim('maternity')} AS l_caes, {claim('dialysis')} AS l_dial,
    list_filter([{', '.join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for w in words)}], lambda x: x IS NOT NULL) AS l_specs,
    substr(t, 1, 300) AS raw_text_used
  FROM (SELECT *, lower(user_msg) AS t FROM llm0)
),
llm2 AS (
  SELECT *, '{{"icu": {{"present": "' || l_icu || '"}}, "emergency": {{"emergency_care": "' || l_em || '", "is_24_7": '
    || CASE WHEN l_24 THEN 'true' ELSE 'false' END || '}}, "surgery": {{"general_surgery": "' || l_sg || '", "caesarean": "' || l_caes
    || '"}}, "dialysis": {{"present": "' || l_dial || '"}}, "specialties_extracted": ['
    || array_to_string(list_transform(l_specs, lambda x: '"' || x || '"'), ', ') || '], "raw_text_used": "' || {escaped} || '"}}' AS body
  FROM llm1
),
llm3 AS (
  SELECT *, CASE WHEN length(t) % 5 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS content FROM llm2
),
llm AS (
  SELECT *, ({len(EXTRACT_SYSTEM)} + length(user_msg)) // 4 AS prompt_tokens, length(content) // 4 AS completion_tokens FROM llm3
)"""


OFFLINE = _offline_sql()
CHAIN_LLM = CHAIN_GOLD + (OFFLINE,)

# Self-correction of heuristic Gold: the validator objects to two flags, the corrector's record is always the same.
CORRECTION = f"""
low AS (SELECT * FROM gold WHERE trust_score < 0.65),
objected AS (
  SELECT l.facility_id, concat_ws(', ', CASE WHEN contains(',' || l.flag_types || ',', ',SURGERY_NO_ANESTHESIOLOGIST,') THEN '"SURGERY_NO_ANESTHESIOLOGIST"' END,
    CASE WHEN contains(',' || l.flag_types || ',', ',CAESAREAN_NO_ANESTHESIOLOGIST,') THEN '"CAESAREAN_NO_ANESTHESIOLOGIST"' END) AS issues,
    coalesce(b.composite_text_length, 0) AS ctl
  FROM low l LEFT JOIN bronze b ON l.facility_id = b.facility_id
),
fixed AS (
  SELECT facility_id, {rd(f"{dbl(0.9)} * CASE WHEN ctl < 60 THEN {dbl(0.95)} ELSE {dbl(1.0)} END", 3)} AS new_score FROM objected WHERE issues <> ''
),
calls AS (
  SELECT facility_id, 'validation' AS event_type, 'validator' AS agent_name, 1 AS iteration,
    '{{"recommend_correction": ' || CASE WHEN issues <> '' THEN 'true' ELSE 'false' END || ', "issues": [' || issues || ']}}' AS content FROM objected
  UNION ALL SELECT facility_id, 'correction', 'corrector', 1, '{{"staff": {{"anesthesiologist": "on_call"}}, "surgery": {{"general_surgery": "claimed"}}, '
    || '"extraction_notes": "corrected: anaesthesia cover on call"}}' FROM fixed
  UNION ALL SELECT facility_id, 'validation', 'validator', 2, '{{"recommend_correction": false, "issues": []}}' FROM fixed
)"""
CHAIN_CORRECTION = CHAIN_GOLD + (CORRECTION,)

# The model path of the whole pipeline: rules over the stand-in's records, then one round of correction.
LLM_RULES = ("""
extracted AS (
  SELECT facility_id, src_key, address_city, address_stateOrRegion, address_zipOrPostcode, latitude, longitude, name, operatorTypeId,
    l_icu AS icu_present, 'unknown' AS icu_functional, CAST(NULL AS INTEGER) AS icu_beds, 'uncertain' AS vent_present, 'unknown' AS anest,
    'unknown' AS surgeon, 'unknown' AS gp, 0 AS n_spec_types, CAST(NULL AS INTEGER) AS total_doctors, l_em AS em_care, l_24 AS em_24_7,
    l_sg AS sg_general, l_caes AS sg_caes, 'uncertain' AS sg_cardiac, l_dial AS dial_present, facilityTypeId AS facility_type,
    composite_text_length AS ctl
  FROM llm
),""" + RULES + f""",
gold AS (
  SELECT facility_id, nullif(trim(address_zipOrPostcode), '') AS address_zip, nullif(trim(address_stateOrRegion), '') AS address_state,
    latitude, longitude, redo, CASE WHEN redo THEN 1 ELSE 0 END AS correction_iterations,
    CASE WHEN redo THEN {rd(f"{dbl(0.9)} * CASE WHEN ctl < 60 THEN {dbl(0.95)} ELSE {dbl(1.0)} END", 3)} ELSE base_trust END AS trust_score,
    CASE WHEN redo THEN 'uncertain' ELSE icu_present END AS icu_present, CASE WHEN redo THEN 'uncertain' ELSE dial_present END AS dial_present,
    CASE WHEN redo THEN 'uncertain' ELSE em_care END AS em_care, CASE WHEN redo THEN 'claimed' ELSE sg_general END AS sg_general
  FROM (SELECT *, base_trust < 0.65 AND (r1 OR r8) AS redo FROM scored)
)""")
CHAIN_LLM_DESERTS = (RAW, LOADED, BRONZE, OFFLINE, LLM_RULES, DESERTS)
