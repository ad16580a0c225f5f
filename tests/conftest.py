import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from obsweave.session import local_session

    session = local_session(8, "8g")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Literal rows: rows('a int, b string', (1, 'x'))."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
