import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from calibra.session import local_session
    s = local_session("*", shuffle_partitions=8, app="calibra-tests")
    yield s
    s.stop()


def dist_df(spark, rows, schema="id INT, labels ARRAY<STRING>, probs ARRAY<DOUBLE>, truth STRING"):
    return spark.createDataFrame(rows, schema)
