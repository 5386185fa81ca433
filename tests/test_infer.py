"""D1 over every category: in each section the first branch whose keywords occur decides."""

from caregrid.operators import infer as INF
from caregrid.schemas import EXTRACTION
from caregrid.sources.testdata import CATEGORY_CYCLE

SECTIONS = {"icu": (INF.ICU_BRANCHES, INF.ICU_ELSE), "ventilator": (INF.VENT_BRANCHES, INF.VENT_ELSE), "staff": (INF.STAFF_BRANCHES, INF.STAFF_ELSE),
            "emergency": (INF.EMERGENCY_BRANCHES, INF.EMERGENCY_ELSE), "surgery": (INF.SURGERY_BRANCHES, INF.SURGERY_ELSE),
            "dialysis": (INF.DIALYSIS_BRANCHES, INF.DIALYSIS_ELSE)}


def first(branches, default, cat):
    return next((v for kws, v in branches if any(k in cat for k in kws)), default)


def test_first_branch_decides(spark):
    cats = list(CATEGORY_CYCLE) + [None, "O'Neil maternity comprehensive", "teaching specialist", "DISTRICT HOSPITAL", "the _cat_text _fn clinic"]
    rows = [(c, f) for c in cats for f in ("Functional", "Not Functional", "Partially Functional", "", None)]
    df = spark.createDataFrame(rows, "category string, functional_status string")
    for r in df.select("*", INF.infer_extraction("category", "functional_status").alias("e")).collect():
        cat, func = (r["category"] or ""), (r["functional_status"] or "")
        fn = "functional" if func.lower() in ("functional", "") else "unknown"
        for name, (branches, default) in SECTIONS.items():
            want = [{INF.FN: fn, INF.CAT: f"Category: {cat}"}.get(v, v) if isinstance(v, str) else v for v in first(branches, default, cat.lower())]
            assert [r["e"][name][f] for f in EXTRACTION[name].dataType.fieldNames()] == want
        assert r["e"]["specialties_extracted"] == first(INF.SPECIALTY_BRANCHES, [], cat.lower())
        assert r["e"]["raw_text_used"] == f"Category: {cat}. Functional: {func}."
