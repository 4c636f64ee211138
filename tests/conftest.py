import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from millwright.session import build_local_session
    s = build_local_session(cores=4, shuffle_partitions=8, app="millwright-tests")
    yield s
    s.stop()
