import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from storytrack.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="storytrack-warehouse-", dir="/tmp")  # catalog tables of tests
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="storytrack-tests",
                      extra={"spark.sql.warehouse.dir": warehouse})
    yield s


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)
