import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from calib.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect a DataFrame as a sorted list of tuples."""
    return lambda df, *cols: sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
