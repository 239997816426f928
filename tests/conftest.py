import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablerecon.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="tablerecon-warehouse-")
    session = local_session(
        "tests", 8, **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": warehouse}
    )
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples."""

    def collect(df, *cols):
        view = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in view.collect()), key=repr)

    return collect
