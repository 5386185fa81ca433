"""Driver contract smoke test on sf0.001."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_entry_and_catalog(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    for key in ("A1", "D11", "V2", "D15"):
        assert qs[key](spark, SF).count() > 0
