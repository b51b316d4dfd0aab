import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from repolytics.session import make_session

    session = make_session(cores=8, app="tests")
    yield session
    session.stop()
