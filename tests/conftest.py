import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
sys.path.insert(0, os.path.dirname(HERE))


@pytest.fixture(scope="session")
def spark():
    from oracle import make_spark

    session = make_spark()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
