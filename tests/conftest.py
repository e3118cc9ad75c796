import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tillroll.session import get_session
    s = get_session("local[*]", 8, app="tillroll-tests", extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tillroll-test-ckpt-"),
        "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from tests.seed import seed_catalog
    return seed_catalog(spark)
