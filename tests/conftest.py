import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest  # noqa: E402

from cohortry.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4, 4)


@pytest.fixture(autouse=True)
def _free():
    yield
    release()
