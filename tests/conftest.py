import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from caregrid.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=4, app="caregrid-tests")
    s.conf.set("spark.sql.maxMetadataStringLength", "1000")  # tests look for paths in plans, which cuts them at 100 characters otherwise
    yield s
    s.stop()
