"""J10 grid join == brute force, including high latitudes, the antimeridian and large radii."""

import math
import random

from caregrid.operators.geo import candidate_pairs


def _hav(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    dphi, dl = math.radians(lat2 - lat1), math.radians(lon2 - lon1)
    a = math.sin(dphi / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, a)))


def test_grid_equals_brute_force(spark):
    rnd = random.Random(7)
    fac = [(f"f{i}", rnd.uniform(-89.9, 89.9), rnd.uniform(-180, 180)) for i in range(1500)]
    fac += [(f"g{i}", 10 + rnd.uniform(-0.3, 0.3), 179.9 + rnd.uniform(-0.2, 0.2)) for i in range(200)]
    fac = [(i, la, ((lo + 180) % 360) - 180) for i, la, lo in fac]
    req = [(j, rnd.uniform(-89.5, 89.5), rnd.uniform(-180, 180), rnd.choice([1.0, 25.0, 300.0, 1000.0]))
           for j in range(150)]
    req += [(1000, 10.0, 179.95, 50.0), (1001, 89.9, 0.0, 500.0), (1002, -89.99, 45.0, 40.0)]
    fdf = spark.createDataFrame(fac, "facility_id string, latitude double, longitude double")
    rdf = spark.createDataFrame(req, "request_id long, lat double, lon double, radius_km double")
    got = {(r[0], r[1]) for r in candidate_pairs(rdf, fdf).select("request_id", "facility_id").collect()}
    want = set()
    for j, la, lo, rad in req:
        for i, fla, flo in fac:
            if round(_hav(la, lo, fla, flo) + 1e-12, 2) <= rad:
                want.add((j, i))
    # rounding differences at exactly x.xx5 km are immaterial; compare with 0.01 km tolerance
    missing = {p for p in want - got}
    assert not missing, list(missing)[:5]
    extra = got - want
    assert len(extra) <= 2


def test_pairs_and_distances_equal_the_exact_formula(spark):
    from pyspark.sql import functions as F

    from caregrid.functions.core import haversine_km, rnd

    r = random.Random(11)
    fac = [(f"f{i}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(400)]
    fac += [(f"c{i}", 10 + r.uniform(-0.4, 0.4), 7 + r.uniform(-0.4, 0.4)) for i in range(400)]
    fac += [("same", 10.0, 7.0), ("same", 10.0, 7.0), ("pole", 90.0, 0.0)]
    req = [(j, 10 + r.uniform(-0.2, 0.2), 7 + r.uniform(-0.2, 0.2), r.choice([0.005, 1.0, 7.25, 30.0])) for j in range(100)]
    req += [(900, 10.0, 7.0, 1.0), (900, 10.0, 7.0, 1.0), (901, 89.0, 3.0, 400.0), (902, -10.0, -173.0, 7000.0), (903, 0.0, 0.0, 20030.0),
            (904, 0.0, 0.0, None)]
    fdf = spark.createDataFrame(fac, "facility_id string, latitude double, longitude double")
    rdf = spark.createDataFrame(req, "request_id long, lat double, lon double, radius_km double")
    columns = ["request_id", "facility_id", "distance_km"]
    exact = rdf.crossJoin(fdf).withColumn("distance_km", rnd(haversine_km("lat", "lon", "latitude", "longitude"), 2))
    want = sorted(map(tuple, exact.where(F.col("distance_km") <= F.col("radius_km")).select(columns).collect()))
    assert sorted(map(tuple, candidate_pairs(rdf, fdf).select(columns).collect())) == want and len(want) > 5000


def test_written_pairs_take_few_bytes(spark, tmp_path):
    """Facility by facility, an id is a run of repeats; by request, over more ids than Parquet keeps in a dictionary, each row holds one whole."""
    from pyspark.sql import functions as F

    def places(n, seed):
        return spark.range(0, n, 1, 4).select("id", (F.rand(seed) + 10).alias("a"), (F.rand(seed + 1) + 7).alias("b"))

    fac = places(24_000, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("facility_id"), F.col("a").alias("latitude"), F.col("b").alias("longitude"))
    req = places(200_000, 5).select(F.col("id").alias("request_id"), F.col("a").alias("lat"), F.col("b").alias("lon"), F.lit(1.0).alias("radius_km"))
    fac.write.parquet(str(tmp_path / "facilities"))
    fac, out = spark.read.parquet(str(tmp_path / "facilities")), str(tmp_path / "pairs")  # a table that Spark would broadcast
    candidate_pairs(req, fac).select("request_id", "facility_id", "distance_km").write.parquet(out)
    rows = spark.read.parquet(out).count()
    assert rows > 1_000_000 and sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 16 * rows


def test_rounding_by_doubles_equals_rounding_by_decimals(spark):
    from pyspark.sql import functions as F

    from caregrid.functions.core import rnd, with_rounded

    x = spark.range(200_000).select(((F.col("id") - 1000) / 2000).alias("x")).unionByName(
        spark.range(200_000).select((F.rand(3) * 20016).alias("x"))).unionByName(spark.createDataFrame([(None,), (0.0,), (1.004999999,), (1.0049999999,)], "x double"))
    for scale in (2, 4):
        both = with_rounded(x, "y", F.col("x"), scale).withColumn("z", rnd("x", scale))
        assert both.where(~F.col("y").eqNullSafe(F.col("z"))).count() == 0 and both.where("y is null").count() == 1
