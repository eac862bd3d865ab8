import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sparkwright.session import build_session

    import tempfile

    # managed tables of the tests go to a scratch warehouse, not into the working directory
    s = build_session("local[*]", 8, app_name="sparkwright-tests",
                      conf={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="sparkwright-wh-")})
    yield s
    s.stop()
