import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quadrat.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark__sql__shuffle__partitions": "4"})
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples in a fixed order."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
