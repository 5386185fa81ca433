"""Batch model jobs: prompt assembly (X11), completion calls (L1), incremental
extraction into Silver (L2, A12), validate-and-correct rounds (L3, L4), audit
rows (L5) and the whole pipeline (L6).

The model is an injected callable ``completer(messages: list[dict]) -> dict``
returning ``{"content", "prompt_tokens", "completion_tokens"}``; it runs inside
executors through ``mapInArrow`` (one call per row, ``concurrency`` calls at a
time in a task, errors captured per row). Every completion batch is written to a
table before it is parsed or split, so later steps re-read the written calls; a
task that is retried or speculated calls the model again for its rows (calls are
at least once, and kept by key).
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregrid.config import DEFAULT, Params
from caregrid.functions.core import col
from caregrid.functions.parse import parse_replies, unfence
from caregrid.functions.text import truncate

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
CALL_FIELDS = [
    T.StructField("content", T.StringType()), T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()), T.StructField("latency_ms", T.DoubleType()),
    T.StructField("call_error", T.StringType()),
]

EXTRACT_SYSTEM = (
    "You read a health facility description and return one JSON object with the sections "
    "icu, ventilator, staff, emergency, surgery, dialysis, specialties_extracted, extraction_notes "
    "and raw_text_used. Use confirmed/claimed/not_present/uncertain for availability, "
    "full_time/part_time/visiting/on_call/unknown for staff. Return JSON only."
)
VALIDATE_SYSTEM = (
    "You check an extracted facility record against the rule flags raised on it. "
    "Return JSON {\"recommend_correction\": bool, \"issues\": [str]}."
)
CORRECT_SYSTEM = (
    "You correct an extracted facility record given its source text and the issues found. "
    "Return the corrected record as one JSON object."
)

RANK_SYSTEM = (
    "You rank candidate facilities for a query. Return JSON {\"query_interpretation\": str, \"ranked_results\": "
    "[{\"rank\", \"facility_id\", \"facility_name\", \"suitability_score\", \"reasoning\", "
    "\"matched_capabilities\", \"warnings\", \"citations\"}], \"recommendation_summary\": str, \"uncertainty_note\": str}."
)
# How much source text a prompt carries.
EXTRACT_CHARS, CORRECT_CHARS = 3000, 2000
CALL_ROWS = 256  # messages and replies that a task holds as Python objects


# ---------------------------------------------------------------------------
# X11 prompt assembly
# ---------------------------------------------------------------------------

def messages(system: str, user: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    ).cast(MESSAGES)


def extraction_messages(text: str | Column, facility_id: str | Column, chars: int = EXTRACT_CHARS) -> Column:
    """X11 + X9: extraction prompt over the first ``chars`` characters of the composite text."""
    user = F.concat(F.lit("Facility id: "), col(facility_id), F.lit("\nDescription:\n"), truncate(text, chars))
    return messages(EXTRACT_SYSTEM, user)


def validation_messages(ex: str | Column, flags: str | Column, ftype: str | Column, doctors: str | Column) -> Column:
    user = F.concat(
        F.lit("Facility type: "), F.coalesce(col(ftype), F.lit("unknown")),
        F.lit("\nNumber of doctors: "), F.coalesce(col(doctors).cast("string"), F.lit("unknown")),
        F.lit("\nRecord:\n"), F.to_json(col(ex), {"ignoreNullFields": "false"}),
        F.lit("\nFlags:\n"), F.to_json(col(flags)),
    )
    return messages(VALIDATE_SYSTEM, user)


def correction_messages(ex: str | Column, issues: str | Column, text: str | Column, chars: int = CORRECT_CHARS) -> Column:
    user = F.concat(
        F.lit("Source text:\n"), truncate(F.coalesce(col(text), F.lit("")), chars),
        F.lit("\nRecord:\n"), F.to_json(col(ex), {"ignoreNullFields": "false"}),
        F.lit("\nIssues:\n"), F.to_json(col(issues)),
    )
    return messages(CORRECT_SYSTEM, user)


def ranking_messages(query: str | Column, min_trust: str | Column, candidates: str | Column, top_k: str | Column) -> Column:
    """X11: ranking prompt over a query's candidate summaries (X12) as JSON."""
    n = F.size(col(candidates)).cast("string")
    user = F.concat(
        F.lit('User Query: "'), col(query), F.lit('"\n\nTrust threshold for recommendation: '), col(min_trust).cast("string"),
        F.lit("\n\nCandidate Facilities ("), n, F.lit(" total):\n"), F.to_json(col(candidates), {"ignoreNullFields": "false"}),
        F.lit("\n\nRank these candidates. Return the top "), col(top_k).cast("string"), F.lit(" with reasons."))
    return messages(RANK_SYSTEM, user)


# ---------------------------------------------------------------------------
# L1 completion calls
# ---------------------------------------------------------------------------

def one_call(completer, msgs) -> tuple:
    """The values of ``CALL_FIELDS`` for one call."""
    msgs = [{"role": m["role"], "content": m["content"]} for m in msgs]
    t0 = time.perf_counter()
    try:
        r = completer(msgs)
        out = (r.get("content"), int(r.get("prompt_tokens") or 0), int(r.get("completion_tokens") or 0))
        error = None
    except Exception as e:  # noqa: BLE001 - a failed call is a failure row
        out, error = (None, 0, 0), f"{type(e).__name__}: {e}"
    return (*out, (time.perf_counter() - t0) * 1000.0, error)


def complete(df: DataFrame, messages_col: str, completer, partitions: int | None = None, concurrency: int = 1) -> DataFrame:
    """L1: one completer call per row inside executors; per-row failures become ``call_error``.

    At most ``partitions`` (tasks) x ``concurrency`` (threads of a task) calls run against the endpoint at
    once. ``input_hash`` is the SHA-256 of the messages sent.
    """
    src = df.repartition(partitions) if partitions else df
    src = src.withColumn("input_hash", F.sha2(F.to_json(messages_col), 256))
    schema = T.StructType(src.schema.fields + CALL_FIELDS)

    types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]  # of CALL_FIELDS

    def run(batches):  # the other columns pass as Arrow; Python holds the messages and replies of CALL_ROWS rows
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                for start in range(0, b.num_rows, CALL_ROWS):
                    part = b.slice(start, CALL_ROWS)
                    msgs = part.column(part.schema.get_field_index(messages_col)).to_pylist()
                    calls = list(pool.map(lambda m: one_call(completer, m), msgs))
                    out = [pa.array([c[i] for c in calls], t) for i, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *[f.name for f in CALL_FIELDS]])

    return src.mapInArrow(run, schema)


class OfflineCompleter:
    """Deterministic stand-in model for offline runs and tests: reads keywords in the
    user message and answers with a small extraction (or a validation verdict)."""

    def __call__(self, msgs: list[dict]) -> dict:
        system = msgs[0]["content"] if msgs else ""
        text = (msgs[-1]["content"] if msgs else "").lower()
        if system == VALIDATE_SYSTEM:
            issues = [k for k in ("SURGERY_NO_ANESTHESIOLOGIST", "CAESAREAN_NO_ANESTHESIOLOGIST") if k.lower() in text]
            body = {"recommend_correction": bool(issues), "issues": issues}
        elif system == RANK_SYSTEM:
            user = msgs[-1]["content"]
            found = json.loads(user[user.index(" total):\n") + 9:user.rindex("\n\nRank these")])
            found.sort(key=lambda c: (-c["trust_score"], c["facility_id"]))
            body = {"query_interpretation": "by trust", "ranked_results": [
                {"rank": i, "facility_id": c["facility_id"], "facility_name": c["name"] or "Unknown facility",
                 "suitability_score": c["trust_score"], "reasoning": f"trust {c['trust_score']}"} for i, c in enumerate(found, 1)],
                "recommendation_summary": f"{len(found)} candidates", "uncertainty_note": ""}
        elif system == CORRECT_SYSTEM:
            body = {"staff": {"anesthesiologist": "on_call"}, "surgery": {"general_surgery": "claimed"},
                    "extraction_notes": "corrected: anaesthesia cover on call"}
        else:
            present = lambda *kws: "claimed" if any(k in text for k in kws) else "uncertain"
            body = {
                "icu": {"present": present("icu", "intensive")},
                "emergency": {"emergency_care": present("emergency"), "is_24_7": "24/7" in text},
                "surgery": {"general_surgery": present("surgery"), "caesarean": present("maternity")},
                "dialysis": {"present": present("dialysis")},
                "specialties_extracted": [w for w in ("maternity", "surgery", "immunisation") if w in text],
                "raw_text_used": text[:300],
            }
        content = json.dumps(body)
        if system == EXTRACT_SYSTEM and len(text) % 5 == 0:
            content = "```json\n" + content + "\n```"
        return {"content": content, "prompt_tokens": sum(len(m["content"]) for m in msgs) // 4,
                "completion_tokens": len(content) // 4}


# ---------------------------------------------------------------------------
# L2 incremental extraction
# ---------------------------------------------------------------------------

def run_extract(bronze: DataFrame, completer, silver_path: str, failures_path: str, calls_path: str,
                sample_limit: int = 0, only_missing: bool = True, partitions: int | None = None,
                concurrency: int = 1, text_chars: int = EXTRACT_CHARS, ledger: str | None = None) -> DataFrame:
    """L2: F2 -> J3 -> F3 -> X11 -> L1 (written once) -> X1/X2 (written once) -> ok/failed -> J8 into Silver
    and failures. A later run calls the model only for facilities that Silver lacks. With a ``ledger`` (a folder)
    replies are kept by the hash of their messages while the calls run (``sources.ledger``).

    Returns the run metrics (A12): ok, failed, prompt and completion token totals.
    """
    from caregrid.operators.upsert import merge, pending, read_or_empty, replace_table, upsert_table
    from caregrid.schemas import SILVER
    from caregrid.sources.files import read_table, table_exists

    spark = bronze.sparkSession
    todo = bronze.where(F.length(F.coalesce("composite_text", F.lit(""))) > 0)
    if only_missing and table_exists(spark, silver_path):
        todo = pending(todo, read_table(spark, silver_path), "facility_id")
    if sample_limit > 0:
        todo = todo.orderBy("facility_id").limit(sample_limit)
    req = todo.select("facility_id", extraction_messages("composite_text", "facility_id", text_chars).alias("messages"))
    if ledger:
        from caregrid.sources.ledger import complete_once

        called = complete_once(req, "messages", completer, ledger, partitions, concurrency)
    else:
        called = complete(req, "messages", completer, partitions, concurrency)
    called.drop("messages") \
        .withColumn("_run_ord", F.monotonically_increasing_id()) \
        .write.mode("overwrite").parquet(calls_path)
    is_ok = F.col("extraction").isNotNull() & F.col("call_error").isNull()
    parse_replies(spark.read.parquet(calls_path), "content", "facility_id").select(
        "facility_id", F.when(is_ok, F.to_json("extraction", {"ignoreNullFields": "false"})).alias("extraction_json"),
        F.when(~is_ok, F.coalesce("call_error", F.array_join("errors", "; "))).alias("error"), "content",
        "prompt_tokens", "completion_tokens", "latency_ms", "_run_ord").write.mode("overwrite").parquet(f"{calls_path}_parsed")
    parsed = spark.read.parquet(f"{calls_path}_parsed")
    ok = parsed.where("error is null").select(*SILVER.fieldNames(), "_run_ord")
    failed = parsed.where("error is not null").select("facility_id", "error", F.coalesce("content", F.lit("")).alias("raw_response"), "_run_ord")
    silver = upsert_table(spark, ok, silver_path, "facility_id", "_run_ord")
    # failures: merge the new ones, then drop any id that has since succeeded
    merged = merge(read_or_empty(spark, failures_path, failed.schema), failed, "facility_id", "_run_ord")
    replace_table(spark, pending(merged, silver), failures_path)
    return run_metrics(parsed)


def run_metrics(parsed: DataFrame) -> DataFrame:
    """Ok / failed counts and token totals of one extraction run."""
    return parsed.agg(
        F.count_if(F.col("error").isNull()).cast("long").alias("ok"),
        F.count_if(F.col("error").isNotNull()).cast("long").alias("failed"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("long").alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("long").alias("completion_tokens"),
    )


# ---------------------------------------------------------------------------
# L3-L5 validate -> correct rounds, audit rows
# ---------------------------------------------------------------------------

VALIDATION = T.StructType([T.StructField("recommend_correction", T.BooleanType()),
                           T.StructField("issues", T.ArrayType(T.StringType()))])


def self_correct(gold: DataFrame, bronze: DataFrame, completer, work_dir: str, params: Params = DEFAULT,
                 sample_limit: int = 0, model: str = "injected", concurrency: int = 1,
                 text_chars: int = CORRECT_CHARS) -> tuple[DataFrame, DataFrame]:
    """L4: low-trust Gold rows (F4) with their source text (J4), at most ``max_correction_iterations``
    validator/corrector rounds (L3) over the rows still active, then re-score (D2, D3, X13 with
    number_doctors = null) and a matched-only update of Gold (J9). Returns (new Gold, audit rows L5).

    Each round's calls are written to ``work_dir`` before they are used (the bounded driver loop
    runs at most ``max_correction_iterations`` distributed rounds; it never collects rows).
    """
    from caregrid.operators.gold import embedding_text
    from caregrid.operators.trust import confidence, trust_flags, trust_score_from_flags
    from caregrid.operators.upsert import update_matched
    from caregrid.session import stored

    spark = gold.sparkSession
    low = gold.where(F.col("trust_score") < params.low_trust_threshold)
    low = low.join(bronze.select("facility_id", "composite_text", "composite_text_length", "numberDoctors"),
                   "facility_id", "left")
    if sample_limit > 0:
        low = low.orderBy("facility_id").limit(sample_limit)
    active = low.select("facility_id", "extraction", "trust_flags", "composite_text", "composite_text_length",
                        "facility_type", "numberDoctors", F.lit(0).alias("iterations"))
    audits = []
    for it in range(1, params.max_correction_iterations + 1):
        vreq = active.select("*", validation_messages("extraction", "trust_flags", "facility_type", "numberDoctors")
                             .alias("messages"))
        vpath = f"{work_dir}/validate_{it}"
        complete(vreq, "messages", completer, concurrency=concurrency).drop("messages").write.mode("overwrite").parquet(vpath)
        v = spark.read.parquet(vpath).withColumn("verdict", F.from_json(unfence("content"), VALIDATION))
        audits.append(_audit(v, "validation", "validator", it, model))
        todo = v.where(F.coalesce("verdict.recommend_correction", F.lit(False)))
        creq = todo.select("*", correction_messages("extraction", "verdict.issues", "composite_text", text_chars)
                           .alias("messages")).drop("content", "prompt_tokens", "completion_tokens", "latency_ms",
                                                    "call_error", "input_hash")
        cpath = f"{work_dir}/correct_{it}"
        complete(creq, "messages", completer, concurrency=concurrency).drop("messages").write.mode("overwrite").parquet(cpath)
        c = spark.read.parquet(cpath)
        audits.append(_audit(c, "correction", "corrector", it, model))
        # written before the filter, which would repeat the parse for every field that it reads
        c = stored(parse_replies(c.drop("extraction"), "content", "facility_id").select(
            "facility_id", "extraction", "composite_text", "composite_text_length", "facility_type", "numberDoctors"), "corrections")
        fixed = c.where(F.col("extraction").isNotNull()).withColumn("iterations", F.lit(it))
        fixed = fixed.withColumn("_ctl", F.coalesce("composite_text_length", F.lit(0)))
        fixed = fixed.withColumn("trust_flags", trust_flags("extraction", "facility_type", None, "_ctl")).drop("_ctl")
        fpath = f"{work_dir}/fixed_{it}"
        fixed.write.mode("overwrite").parquet(fpath)
        active = spark.read.parquet(fpath)
        if it == 1:
            corrected = active
        else:
            from caregrid.operators.upsert import merge

            corrected = merge(corrected.withColumn("_o", F.lit(0)), active.withColumn("_o", F.lit(1)),
                              "facility_id", "_o").drop("_o")
    ctl = F.coalesce("composite_text_length", F.lit(0))
    rescored = corrected.select(
        "facility_id", "extraction", "trust_flags",
        trust_score_from_flags("trust_flags").alias("trust_score"),
        confidence("extraction", "trust_flags", ctl).alias("confidence"),
        F.col("iterations").alias("correction_iterations"),
    )
    meta = gold.select("facility_id", "name", "address_city", "address_state", "address_zip", "facility_type")
    rescored = rescored.join(meta, "facility_id", "inner").withColumn(
        "embedding_text", embedding_text("name", "address_city", "address_state", "address_zip", "facility_type",
                                         "extraction", "trust_score"))
    cols = ["extraction", "trust_score", "trust_flags", "confidence", "correction_iterations", "embedding_text"]
    new_gold = update_matched(gold, rescored.select("facility_id", *cols), "facility_id", cols)
    audit = audits[0]
    for a in audits[1:]:
        audit = audit.unionByName(a)
    return new_gold, audit


def _audit(calls: DataFrame, event_type: str, agent: str, iteration: int, model: str) -> DataFrame:
    """One audit row per model call, with sha256 of the messages sent and of the reply."""
    return calls.select(
        F.sha2(F.concat_ws("|", F.col("facility_id"), F.lit(event_type), F.lit(str(iteration))), 256).alias("event_id"),
        "facility_id", F.lit(event_type).alias("event_type"), F.current_timestamp().alias("event_ts"),
        F.lit(agent).alias("agent_name"), F.lit(iteration).alias("iteration"),
        "input_hash", F.sha2(F.coalesce("content", F.lit("")), 256).alias("output_hash"),
        F.lit(model).alias("llm_model"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).cast("int").alias("tokens_used"),
        F.col("latency_ms").cast("float").alias("latency_ms"), F.col("call_error").alias("notes"),
    )


# ---------------------------------------------------------------------------
# L6 the whole pipeline
# ---------------------------------------------------------------------------

def pipeline(spark: SparkSession, raw: DataFrame, root: str, completer=None, embed=None, skip_extract: bool = False,
             skip_correct: bool = False, params: Params = DEFAULT, concurrency: int = 1) -> dict[str, str]:
    """Ingest -> (model or heuristic) Silver -> Gold -> self-correction where a model is given -> vector
    table -> deserts, each stage written under ``root`` so any stage can restart from the previous one.
    ``gold`` is the corrected table once the correction has run."""
    from caregrid.operators.bronze import ingest
    from caregrid.operators.deserts import deserts
    from caregrid.operators.gold import heuristic_gold, rule_gold
    from caregrid.operators.upsert import replace_table
    from caregrid.session import stored
    from caregrid.sources.files import read_table

    paths = {k: f"{root.rstrip('/')}/{k}" for k in ("bronze", "silver", "silver_failures", "calls", "gold",
                                                  "deserts", "audit", "vectors", "work")}
    carry = tuple(c for c in ("category", "functional_status", "accessibility_note", "src_key") if c in raw.columns)
    ingest(raw, carry=carry).write.mode("overwrite").parquet(paths["bronze"])
    bronze = spark.read.parquet(paths["bronze"])
    if completer is None or skip_extract:
        gold = heuristic_gold(bronze)
    else:
        run_extract(bronze, completer, paths["silver"], paths["silver_failures"], paths["calls"],
                    concurrency=concurrency).collect()  # one row
        # written: a filter on the parsed column would be pushed below the parse, which it then repeats for every field it reads
        silver = parse_replies(read_table(spark, paths["silver"]), "extraction_json", "facility_id").select("facility_id", "extraction")
        gold = rule_gold(stored(silver, "silver-parsed"), bronze)
    gold = replace_table(spark, gold, paths["gold"], key="facility_id")
    if completer is not None and not skip_correct:
        new_gold, audit = self_correct(gold, bronze, completer, paths["work"], params, concurrency=concurrency)
        audit.write.mode("append").parquet(paths["audit"])
        gold = replace_table(spark, new_gold, paths["gold"])
    if embed is not None:
        embed(gold).write.mode("overwrite").parquet(paths["vectors"])
    deserts(gold, params).write.mode("overwrite").parquet(paths["deserts"])
    return paths
