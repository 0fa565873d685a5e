import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from parcelwise.session import get_spark
    s = get_spark("local[4]", app="parcelwise-tests", shuffle_partitions=8)
    yield s
    s.stop()
