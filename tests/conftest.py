import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))  # for the Python workers


@pytest.fixture(scope="session")
def spark():
    from glyphwell.session import local_session

    session = local_session(4, 4, "4g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
