"""Headline benchmark: prints ONE JSON line.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``:

* gold_assembly   raw registry rows -> Bronze -> heuristic Gold, written as Parquet (D4/D5 path)
* rule_gold       heuristic Silver as JSON -> validated Silver -> rule Gold (X2 + J1 + D4)
* deserts         area coverage + risk + categories over Gold (A1 + D16 + D17)
* nearest_grid    top-5 nearest trusted facilities for every event request (D11, grid join)
* nearest_fallback D12 (every request answered, with the wider second try)
* nearest_46k     D11 for every event request over about 46,000 facilities (customers, suppliers, an orders split)
* nearest_one     one request over the key-ordered table of the same facilities, planning included: the median of 15
* vector_post / vector_pre   exact top-k for every embedding query (W3 and V2)
* query_rank      vector retrieval + re-validation + deterministic ranker (D15)

Large results go to Spark's ``noop`` sink (the work runs, nothing is collected);
timings include planning. ``nearest_one`` is a single request's latency; ``nearest_ms_per_request``
divides the time of the whole batch by its requests.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from caregrid.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="caregrid-bench")
    from pyspark.sql import functions as F

    from caregrid.operators import deserts as DZ
    from caregrid.operators import facility_index as FI
    from caregrid.operators import geo as GEO
    from caregrid.operators import rank as RK
    from caregrid.operators import vector as VX
    from caregrid.operators.reports import rule_gold_from_heuristic_silver
    from caregrid.plans import pipeline as PL
    from caregrid.sources.testdata import nearest_requests, read_table, vector_queries

    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    # warm-up: JVM start, first codegen (not reported)
    read_table(spark, sf_dir, "region").count()

    gold = timed("gold_assembly", lambda: PL.gold(spark, sf_dir))
    n_gold = gold.count()
    timed("rule_gold", lambda: noop(rule_gold_from_heuristic_silver(
        PL.bronze(spark, sf_dir), PL.table_path(spark, sf_dir, "silver_bench"))))
    timed("deserts", lambda: DZ.deserts(gold).collect())

    req = nearest_requests(spark, sf_dir)
    n_req = req.count()
    timed("nearest_grid", lambda: noop(GEO.rank_nearest(req, gold)))
    timed("nearest_fallback", lambda: noop(GEO.nearest_with_fallback(req, gold)))

    big = timed("gold_46k", lambda: gold_46k(spark, sf_dir))
    n_big = big.count()
    timed("nearest_46k", lambda: noop(GEO.rank_nearest(req, big)))
    served = PL.table_path(spark, sf_dir, "candidates_46k")
    FI.write_table(GEO.facility_candidates(big), served)
    fac, one = FI.open_table(spark, served), []
    for r in req.where(F.col("request_id") % 7 == 0).limit(15).collect():
        t0 = time.perf_counter()
        FI.nearest_one(fac, r.asDict()).collect()
        one.append(time.perf_counter() - t0)
    times["nearest_one"] = round(sorted(one)[len(one) // 2], 3)

    vt_path = PL.table_path(spark, sf_dir, "vectors_bench")
    VX.vector_table(gold, read_table(spark, sf_dir, "embeddings"), dim=64).write.mode("overwrite").parquet(vt_path)
    vt = spark.read.parquet(vt_path)
    qs = vector_queries(spark, sf_dir)
    n_q = qs.count()
    timed("vector_post", lambda: noop(VX.search(qs, vt, top_k=5, mode="postfilter")))
    timed("vector_pre", lambda: noop(VX.search(qs, vt, top_k=5, mode="prefilter")))
    timed("query_rank", lambda: noop(RK.query_facilities(qs, vt, gold)[0]))

    extra["nearest_46k_ms_per_request"] = round(times["nearest_46k"] * 1000.0 / max(1, n_req), 4)
    extra["nearest_ms_per_request"] = round(times["nearest_grid"] * 1000.0 / max(1, n_req), 4)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "rows": {"gold": n_gold, "gold_46k": n_big, "requests": n_req, "vector_queries": n_q},
        "derived": extra,
        "spark": spark.version,
        "cores": int(cpus),
    }))
    spark.stop()


def gold_46k(spark, sf_dir):
    """Heuristic Gold of about 46,000 facilities, written and read back."""
    from pyspark.sql import functions as F

    from caregrid.operators.bronze import ingest
    from caregrid.operators.gold import heuristic_gold
    from caregrid.plans import pipeline as PL
    from caregrid.sources.national import load_national, union_splits
    from caregrid.sources.testdata import national_raw, national_raw_orders, national_raw_suppliers

    sup = national_raw_suppliers(spark, sf_dir).select("src_key", "src_ord", F.col("alt_name").alias("prmry_name"), F.col("y").alias("latitude"),
                                                       F.col("x").alias("longitude"), "statename", "lganame")
    raw = union_splits([national_raw(spark, sf_dir), sup, national_raw_orders(spark, sf_dir)])
    path = PL.table_path(spark, sf_dir, "gold_46k")
    heuristic_gold(ingest(load_national(raw), carry=PL.CARRIED)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


if __name__ == "__main__":
    main()
