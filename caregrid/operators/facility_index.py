"""Indexes over facility candidates: single requests by key ranges, large radii by bounds, counts without pairs.

* ``write_table``: candidates stored by a Z-order key of their place. ``nearest_one`` turns a request into a few key
  ranges that the scan pushes down to row groups and pages; the top_k follows without a shuffle.
* ``nearest_pruned`` (D11 at any radius), ``count_in_radius``, ``radius_summary`` (D7), ``count_eligible`` (F5): over
  the tiles of ``operators.tiles``, which bound the scores and distances of groups of facilities.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caregrid.config import DEFAULT, Params
from caregrid.functions.core import EARTH_RADIUS_KM, haversine_km
from caregrid.operators import geo as G

BITS = 20  # of the key, for each of latitude and longitude
RANGES = 24  # key ranges of one request


# ---- Z-order table and single requests

def with_key(places: DataFrame) -> DataFrame:
    """Adds ``z``: the bits of latitude and longitude in turn, latitude first."""
    cell = lambda c, low, span: F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor((F.col(c) - low) / span * (1 << BITS)))).cast("long")
    d = places.withColumns({"_y": cell("latitude", -90.0, 180.0), "_x": cell("longitude", -180.0, 360.0)})
    for shift in (16, 8, 4, 2, 1):  # move the upper half of each group of 2 * shift bits up by shift
        mask = sum(((1 << shift) - 1) << at for at in range(0, 63, 2 * shift))
        d = d.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask)) for c in ("_y", "_x")})
    return d.withColumn("z", F.shiftleft("_y", 1).bitwiseOR(F.col("_x"))).drop("_y", "_x")


def write_table(candidates: DataFrame, path: str, row_group_bytes: int = 4 << 20) -> DataFrame:
    """Candidates (``geo.facility_candidates``) written by key order, so that files, row groups and pages cover key ranges."""
    t = with_key(candidates)
    t.repartitionByRange("z").sortWithinPartitions("z", "facility_id").write.mode("overwrite").option(
        "parquet.block.size", row_group_bytes).parquet(path)
    return candidates.sparkSession.read.schema(t.schema).parquet(path)


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_table`` for single requests, in a session of its own: a request meets few rows, for which Spark's
    compilation of generated code would take longer than the work."""
    serving = spark.newSession()
    serving.conf.set("spark.sql.codegen.wholeStage", "false")
    serving.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return serving.read.parquet(path)


def key_ranges(lat: float, lon: float, radius_km: float, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` key ranges that hold every place within the radius (and places around)."""
    delta = (radius_km + G.RADIUS_SLACK_KM) / EARTH_RADIUS_KM
    dlat = math.degrees(delta)
    low, high = max(-90.0, lat - dlat), min(90.0, lat + dlat)
    ratio = math.sin(delta) / max(1e-12, math.cos(math.radians(lat)))
    dlon = 360.0 if low <= -90 or high >= 90 or ratio >= 1 or delta >= math.pi / 2 else math.degrees(math.asin(ratio)) * (1 + 1e-9)
    spans = [(-180.0, 180.0)] if dlon >= 180 else [(lon - dlon, lon + dlon)]
    if dlon < 180:  # over the antimeridian: both ends
        spans += [(a + s, b + s) for a, b in spans for s in (-360.0, 360.0)]
    n = 1 << BITS
    cut = lambda x, base, span: min(n - 1, max(0, math.floor((x - base) / span * n)))
    y0, y1 = cut(low, -90, 180), cut(high, -90, 180)
    boxes = [(y0, y1, cut(a, -180, 360), cut(b, -180, 360)) for a, b in spans if b >= -180 and a <= 180]
    inside = lambda y, x, s: any(b[0] <= y and y + s - 1 <= b[1] and b[2] <= x and x + s - 1 <= b[3] for b in boxes)
    meets = lambda y, x, s: any(y <= b[1] and y + s > b[0] and x <= b[3] and x + s > b[2] for b in boxes)
    done, open_ = [], [(0, 0, 0, n)]  # first key, row, column, edge of squares that some box cuts
    while open_ and len(done) + len(open_) < 4 * most:
        key, y, x, s = open_.pop(0)
        if s == 1 or inside(y, x, s):
            done.append((key, key + s * s - 1))
            continue
        h = s // 2
        for i, (yy, xx) in enumerate(((y, x), (y, x + h), (y + h, x), (y + h, x + h))):
            if meets(yy, xx, h):
                open_.append((key + i * h * h, yy, xx, h))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(done + [(k, k + s * s - 1) for k, _, _, s in open_]):
        if merged and a == merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    while len(merged) > most:  # close the smallest gaps
        i = min(range(len(merged) - 1), key=lambda j: merged[j + 1][0] - merged[j][1])
        merged[i:i + 2] = [(merged[i][0], merged[i + 1][1])]
    return merged


def valid_request(request: dict, params: Params = DEFAULT) -> dict:
    """One request with its defaults; ``ValueError`` names every value out of bounds (as ``geo.check_requests``)."""
    r = {"request_id": request.get("request_id"), "need_type": (request.get("need_type") or "general").lower(),
         "functional_only": bool(request.get("functional_only"))}
    errors = []
    for name, (low, high, default) in G.REQUEST_BOUNDS.items():
        v = request.get(name)
        v = (params.max_radius_km if name == "radius_km" else default) if v is None else v
        if v is None or not low <= v <= high:
            errors.append(f"{name} must be between {low:g} and {high:g}")
        r[name] = v
    if errors:
        raise ValueError("; ".join(errors))
    return r


@functools.lru_cache(maxsize=8)
def _serving_columns(application: str, params: Params) -> tuple:
    """The columns of ``nearest_one`` that do not depend on the request, made once (each is a dozen calls to the JVM)."""
    order = [F.desc("composite_score"), F.asc("facility_id")]
    distance = G.rnd(haversine_km("lat", "lon", "latitude", "longitude"), 2)
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))  # top_k rows
    cap = G.need_score(F.col("need_type"))
    return (distance, G.is_eligible() & (F.col("distance_km") <= F.col("radius_km")), cap, G.composite(F.col("cap_score"), params), order, place,
            G.display_columns(params))


def nearest_one(table: DataFrame, request: dict, params: Params = DEFAULT) -> DataFrame:
    """D11 for one request over a table of ``write_table``: the columns of ``geo.rank_nearest``."""
    r = valid_request(request, params)
    distance, near, cap, score, order, place, shown = _serving_columns(table.sparkSession.sparkContext.applicationId, params)
    where = " OR ".join(f"(z >= {a}L AND z <= {b}L)" for a, b in key_ranges(r["lat"], r["lon"], r["radius_km"]))
    asked = {"lat": float(r["lat"]), "lon": float(r["lon"]), "radius_km": float(r["radius_km"]), "min_trust_score": float(r["min_trust_score"])}
    rows = table.where(where).withColumns({n: F.lit(r[n]) for n in ("request_id", "need_type", "functional_only")} | {n: F.lit(v) for n, v in asked.items()})
    rows = rows.withColumn("distance_km", distance).where(near).withColumn("cap_score", cap).withColumn("composite_score", score)
    return rows.orderBy(*order).limit(int(r["top_k"])).withColumn("rank", place).select(*shown)


# ---- tiles

def pruned_top(requests: DataFrame, fac: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(the top_k rows of each request, as ``geo.top_rows``; the scored rows that they come from).

    ``requests``: valid ones (``geo.check_requests``); ``fac``: narrow candidates.
    """
    from caregrid.operators import tiles

    scored = tiles.top(requests, tiles.build(fac), params)
    return G.top_rows(scored), scored


def nearest_pruned(requests: DataFrame, gold: DataFrame | None, params: Params = DEFAULT, candidates: DataFrame | None = None) -> DataFrame:
    """D11 with upper bounds: the rows of ``geo.rank_nearest``, for batches whose radii hold many facilities."""
    fac = G.facility_candidates(gold) if candidates is None else candidates
    req, _ = G.check_requests(requests, params)
    top, _ = pruned_top(req, fac.select(*G.NARROW), params)
    return G.display(top.join(fac.select("facility_id", *G.DISPLAYED), "facility_id", "inner"), params)


def count_in_radius(requests: DataFrame, fac: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(request_id, n_in_radius) of every valid request: candidates within its radius, whatever its filters."""
    from caregrid.operators import tiles

    n = tiles.within(unfiltered(requests), tiles.build(fac.select(*G.NARROW)), params=params).withColumnRenamed("n", "n_in_radius")
    return requests.select("request_id").join(n, "request_id", "left").select("request_id", F.coalesce("n_in_radius", F.lit(0)).alias("n_in_radius"))


def unfiltered(requests: DataFrame) -> DataFrame:
    """The same requests for facilities of any status and trust."""
    return requests.withColumns({"min_trust_score": F.lit(0.0), "functional_only": F.lit(False)})


def radius_summary(requests: DataFrame, fac: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(request_id, n, nearest_km, farthest_km) of the requests with a candidate within the radius, whatever their filters."""
    from caregrid.operators import tiles

    return tiles.within(unfiltered(requests), tiles.build(fac.select(*G.NARROW)), extremes=True, params=params)


def count_eligible(requests: DataFrame, fac: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(request_id, n) of the valid requests with an eligible candidate (``geo.eligible_pairs``) within the radius."""
    from caregrid.operators import tiles

    return tiles.within(requests, tiles.build(fac.select(*G.NARROW)), params=params)


def rank_nearest_counted(requests: DataFrame, gold: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """D11 with ``n_in_radius`` beside the returned rows; both come from the same tiles."""
    from caregrid.operators import tiles

    fac = G.facility_candidates(gold)
    valid, _ = G.check_requests(requests, params)
    built = tiles.build(fac.select(*G.NARROW))
    n = tiles.within(unfiltered(valid), built, params=params).withColumnRenamed("n", "n_in_radius")
    n = valid.select("request_id").join(n, "request_id", "left").withColumn("n_in_radius", F.coalesce("n_in_radius", F.lit(0)))
    return G.rank_nearest(requests, None, params, fac, built).join(n, "request_id")
