"""Key ranges, bounds and cell counts give the rows of the plain grid join and of brute force."""

import math
import random

import pytest

from caregrid.operators import facility_index as FI
from caregrid.operators import geo as G

REQ = ("request_id long, lat double, lon double, need_type string, top_k int, radius_km double, min_trust_score double, functional_only boolean")
FAC = ("facility_id string, name string, latitude double, longitude double, trust_score double, facility_type string, category string, _func_l string, "
       "functional_status string, address_city string, address_state string, operator_type string, accessibility_note string, "
       "cap_scores struct<emergency:double,icu:double,maternity:double,surgery:double,dialysis:double,pediatric:double,general:double>, "
       "matched_capabilities array<string>")


def hav(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, a)))


def facility(i, lat, lon, rng):
    lon = (lon + 180) % 360 - 180
    func = rng.choice(["functional", "", "not functional"])
    return (f"f{i:05d}", f"n{i}", lat, lon, rng.choice([None, round(rng.random(), 3)]) if i % 9 == 0 else round(rng.random(), 3), "hospital", "c", func, func, "x", "y",
            "public", None, tuple(round(rng.random() ** 3, 3) for _ in range(7)), ["a"])


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(8)
    rows = [facility(i, rng.uniform(4, 14), rng.uniform(3, 14), rng) for i in range(6000)]
    rows += [facility(6000 + i, rng.uniform(-89.9, 89.9), rng.uniform(-180, 180), rng) for i in range(600)]
    rows += [facility(7000 + i, 10 + rng.uniform(-1, 1), 180 + rng.uniform(-1, 1), rng) for i in range(200)]
    rows += [facility(8000 + i, 9.5, 7.5, rng) for i in range(100)] + [facility(8200, 90.0, 0.0, rng), facility(8201, 0.0, 180.0, rng), facility(8202, -90.0, 10.0, rng)]
    return spark.createDataFrame(rows, FAC).repartition(4).cache(), rows


def requests(rng, n, radii):
    needs = ["emergency", "icu", "maternity", "surgery", "dialysis", "pediatric", "general", "other"]
    out = [(i, rng.uniform(3, 15), rng.uniform(2, 15), rng.choice(needs), rng.choice([1, 5, 20]), rng.choice(radii), rng.choice([0.0, 0.5]), rng.random() < 0.3) for i in range(n)]
    return [*out, (900, 10.0, 179.95, "icu", 5, 80.0, 0.0, False), (901, 89.9, 0.0, "icu", 5, 500.0, 0.0, False), (902, -89.99, 45.0, "icu", 5, 400.0, 0.0, False),
            (903, 9.5, 7.5, "general", 20, 1.0, 0.0, False), (904, 0.0, -179.9, "surgery", 5, 60.0, 0.0, False), (905, -40.0, -100.0, "surgery", 5, 2.0, 0.0, False)]


def test_bounds_give_the_rows_of_the_grid_join(spark, places):
    fac, _ = places
    req = spark.createDataFrame(requests(random.Random(3), 60, [3.0, 40.0, 200.0, 500.0]), REQ)
    key = lambda df: sorted(map(tuple, df.drop("facility_meta", "matched_capabilities").collect()))
    assert key(FI.nearest_pruned(req, None, candidates=fac)) == key(G.rank_nearest(req, None, candidates=fac))


def test_few_pairs_are_scored_at_a_large_radius(spark, places):
    fac, _ = places
    rng = random.Random(5)
    req = spark.createDataFrame([(i, rng.uniform(5, 13), rng.uniform(4, 13), "icu", 5, 500.0, 0.0, False) for i in range(40)], REQ)
    valid, _ = G.check_requests(req)
    _, scored = FI.pruned_top(valid, fac.select(*G.NARROW))
    assert scored.count() < 0.2 * G.candidate_pairs(valid, fac.select(*G.NARROW)).count()


def test_counts_equal_brute_force(spark, places):
    fac, rows = places
    reqs = requests(random.Random(6), 60, [1.0, 30.0, 150.0, 500.0])
    valid, _ = G.check_requests(spark.createDataFrame(reqs, REQ))
    got = {r[0]: r[1] for r in FI.count_in_radius(valid, fac).collect()}
    for r in reqs:
        d = [hav(r[1], r[2], f[2], f[3]) for f in rows]
        low, high = sum(x <= r[5] - 0.006 for x in d), sum(x <= r[5] + 0.006 for x in d)  # distances are rounded to 0.01 km
        assert low <= got[r[0]] <= high
    assert got[905] == 0 and got[903] >= 100


def test_key_ranges_hold_the_circle(places):
    rng = random.Random(2)
    for _ in range(60):
        lat, lon, radius = rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice([1.0, 20.0, 500.0])
        ranges = FI.key_ranges(lat, lon, radius)
        assert 1 <= len(ranges) <= FI.RANGES and all(a <= b for a, b in ranges)
        for _ in range(40):
            bearing, d = rng.uniform(0, 2 * math.pi), radius / 6371.0 * rng.random()
            p = math.asin(math.sin(math.radians(lat)) * math.cos(d) + math.cos(math.radians(lat)) * math.sin(d) * math.cos(bearing))
            q = math.radians(lon) + math.atan2(math.sin(bearing) * math.sin(d) * math.cos(math.radians(lat)), math.cos(d) - math.sin(math.radians(lat)) * math.sin(p))
            y = min((1 << 20) - 1, int((math.degrees(p) + 90) / 180 * (1 << 20)))
            x = min((1 << 20) - 1, int(((math.degrees(q) + 180) % 360) / 360 * (1 << 20)))
            z = sum(((y >> i & 1) << 2 * i + 1) | ((x >> i & 1) << 2 * i) for i in range(20))
            assert any(a <= z <= b for a, b in ranges)


def test_one_request_reads_key_ranges(spark, places, tmp_path):
    fac, _ = places
    table = FI.write_table(fac, str(tmp_path / "t"))
    reqs = requests(random.Random(4), 6, [5.0, 60.0, 500.0])
    want = G.rank_nearest(spark.createDataFrame(reqs, REQ), None, candidates=fac)
    rows = {}
    for r in want.drop("facility_meta", "matched_capabilities").collect():
        rows.setdefault(r["request_id"], []).append(tuple(r))
    names = [c.split()[0] for c in REQ.split(", ")]
    for r in reqs:
        got = FI.nearest_one(table, dict(zip(names, r, strict=True)))
        assert got.columns == want.columns
        assert sorted(map(tuple, got.drop("facility_meta", "matched_capabilities").collect())) == sorted(rows.get(r[0], []))
    plan = FI.nearest_one(table, {"lat": 9.0, "lon": 7.0, "radius_km": 50.0})._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("TakeOrderedAndProject"):]
    assert "GreaterThanOrEqual(z" in plan and "Exchange" not in below
    with pytest.raises(ValueError, match="lat must be between -90 and 90; top_k"):
        FI.nearest_one(table, {"lat": 91.0, "lon": 0.0, "top_k": 21})


def test_rings_answer_what_the_first_pass_leaves(spark, places):
    fac, rows = places
    g = fac  # candidates stand in for Gold below
    reqs = [(1, -40.0, -100.0, "icu", 5, 400.0, 0.99, True), (2, 9.0, 7.0, "icu", 3, 30.0, 0.0, False), (3, 89.0, 10.0, "icu", 3, 1.0, 0.0, False)]
    real, G.facility_candidates = G.facility_candidates, lambda gold: gold
    try:
        out = G.nearest_with_fallback(spark.createDataFrame(reqs, REQ), g)
        far = G.nearest_with_fallback(spark.createDataFrame(reqs, REQ), g, factors=(2.0, 4.0, 500.0))
        got, ringed = ({i: sorted((r["rank"], r["facility_id"], r["fallback_used"]) for r in df.collect() if r["request_id"] == i) for i in (1, 2, 3)} for df in (out, far))
    finally:
        G.facility_candidates = real
    assert [x[2] for x in got[2]] == [False] * 3 and got[3] == [(None, None, True)]
    near = [f for f in rows if hav(-40, -100, f[2], f[3]) <= 800]
    assert len(got[1]) == min(5, len(near)) and all(x[2] for x in got[1])
    assert ringed[1] == got[1] and ringed[2] == got[2] and len(ringed[3]) == 3
