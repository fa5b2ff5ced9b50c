import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from touchline.session import get_session
    s = get_session("local[4]", app="touchline-tests", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, order=None):
    """Collected rows as sorted tuples (order-insensitive comparison)."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(
        (x is None, str(type(x)), x if x is not None else 0) for x in t))
