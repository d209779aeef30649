import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from carrierbook.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app_name="carrierbook-tests")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="carrierbook-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def ledger(spark):
    from carrierbook.sources.fixtures import load_fixture_views
    return load_fixture_views(spark, SF_SMALL)
