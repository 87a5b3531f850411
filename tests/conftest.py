import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from motorsight.session import get_spark
    s = get_spark("local[4]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples for order-insensitive comparison."""
    cols = cols or df.columns
    return sorted(tuple(r) for r in df.select(*cols).collect())
