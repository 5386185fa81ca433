"""Desert aggregates from changes equal a rebuild, and only the areas concerned are read and written."""

import random

import pytest

from caregrid.operators import desert_state as DS
from caregrid.operators.deserts import deserts, state_rollup
from caregrid.sources import snapshots as S

GOLD = ("facility_id string, address_zip string, address_state string, trust_score double, latitude double, longitude double, o long, "
        "extraction struct<icu:struct<present:string>,dialysis:struct<present:string>,emergency:struct<emergency_care:string>,surgery:struct<general_surgery:string>>")


def row(rng, i, o, zips):
    avail = lambda: (rng.choice(["confirmed", "claimed", "not_present", None]),)
    return (f"f{i:04d}", rng.choice(zips), rng.choice(["A", "B", None]), rng.choice([None, round(rng.random(), 3)]), rng.choice([None, rng.uniform(4, 14)]),
            rng.uniform(3, 14), o, (avail(), avail(), avail(), avail()))


def shown(df):
    return sorted(((r["pin_code"], r["state"] or "", r["facility_count"], *[None if r[c] is None else round(r[c], 9) for c in (
        "avg_trust_score", "icu_coverage", "dialysis_coverage", "emergency_coverage", "surgery_coverage", "centroid_lat", "centroid_lon", "desert_risk_score")],
        r["is_high_risk"], tuple(r["desert_categories"])) for r in df.collect()))


def test_three_batches_equal_a_rebuild(spark, tmp_path, monkeypatch):
    gold, state, rng = str(tmp_path / "gold"), str(tmp_path / "state"), random.Random(2)
    zips = [str(100 + i) for i in range(60)]
    S.upsert(spark, spark.createDataFrame([row(rng, i, 0, zips) for i in range(600)], GOLD), gold, "facility_id", "o", 40)
    assert DS.refresh(spark, gold, state, 10) == 1
    assert shown(DS.deserts(spark, state)) == shown(deserts(S.read(spark, gold)))
    for o in (1, 2, 3):
        ids = rng.sample(range(700), 12)
        some = rng.sample(zips, 3) + ["  ", None, f"new{o}"]
        S.upsert(spark, spark.createDataFrame([row(rng, i, o, some) for i in ids], GOLD), gold, "facility_id", "o", 40)
        before = set(S.read(spark, state).inputFiles())
        assert DS.refresh(spark, gold, state, 10) == o + 1
        assert shown(DS.deserts(spark, state)) == shown(deserts(S.read(spark, gold)))
        assert len(before - set(S.read(spark, state).inputFiles())) < len(before)
    assert DS.refresh(spark, gold, state) == 4 and S.head(spark, state)["version"] == 4  # nothing to do
    assert state_rollup(DS.deserts(spark, state), None).count() == 3
    # a refresh that dies before its commit is run again
    S.upsert(spark, spark.createDataFrame([row(rng, 5, 9, zips)], GOLD), gold, "facility_id", "o", 40)
    real = S.create_if_absent
    monkeypatch.setattr(S, "create_if_absent", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        DS.refresh(spark, gold, state)
    monkeypatch.setattr(S, "create_if_absent", real)
    assert DS.refresh(spark, gold, state) == 5
    assert shown(DS.deserts(spark, state)) == shown(deserts(S.read(spark, gold)))


def test_areas_of_unchanged_facilities_are_not_touched(spark, tmp_path):
    gold, state, rng = str(tmp_path / "gold"), str(tmp_path / "state"), random.Random(3)
    zips = [str(100 + i) for i in range(90)]
    S.upsert(spark, spark.createDataFrame([row(rng, i, 0, zips) for i in range(900)], GOLD), gold, "facility_id", "o", 50)
    DS.refresh(spark, gold, state, 10)
    S.upsert(spark, spark.createDataFrame([row(rng, 7, 1, ["105"])], GOLD), gold, "facility_id", "o", 50)
    before, after = S.changes(spark, gold, 1, 2)
    assert before.count() <= 60 and after.count() == before.count()
    files = set(S.read(spark, state).inputFiles())
    DS.refresh(spark, gold, state, 10)
    assert 1 <= len(files - set(S.read(spark, state).inputFiles())) <= 2 < len(files)
    assert shown(DS.deserts(spark, state)) == shown(deserts(S.read(spark, gold)))
