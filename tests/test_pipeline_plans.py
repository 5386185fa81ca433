"""The model path parses a reply once: no filter is pushed below the parse, where it would repeat it for every field."""

from caregrid.operators import gold as GOLD
from caregrid.operators import inference as INF


def test_filters_do_not_repeat_the_parse(spark, tmp_path, monkeypatch):
    frame = type(spark.range(1))
    plans, made, filtered = [], GOLD.rule_gold, frame.where

    def rule_gold(silver, bronze, *args):
        plans.append(filtered(silver, "extraction is not null"))
        return made(silver, bronze, *args)

    def where(self, condition):
        out = filtered(self, condition)
        if "extraction" in self.columns and "composite_text" in self.columns:
            plans.append(out)  # the corrected records
        return out

    monkeypatch.setattr(GOLD, "rule_gold", rule_gold)
    rows = [(f"Facility {i}", "City", "State", str(100 + i % 7), 9.0 + i / 100, 7.0, "hospital", "surgery, maternity and emergency care", i) for i in range(40)]
    raw = spark.createDataFrame(rows, "name string, address_city string, address_stateOrRegion string, address_zipOrPostcode string, latitude double, "
                                "longitude double, facilityTypeId string, description string, src_ord long")
    monkeypatch.setattr(frame, "where", where)
    INF.pipeline(spark, raw, str(tmp_path / "run"), completer=INF.OfflineCompleter())
    monkeypatch.undo()
    assert len(plans) >= 3
    for df in plans:
        assert "parsejson" not in df._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
