import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from moorage.session import get_spark

    session = get_spark("tests", 8)
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()
