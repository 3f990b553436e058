import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tipoff.limits import Limits  # noqa: E402
from tipoff.session import local_session  # noqa: E402

TINY = Limits(group_rows=20, block_rows=7, broadcast_rows=0, match_rows=10)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    """Limits small enough that every path for large data is taken."""
    return TINY


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
