import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomtext.session import build_session
    s = build_session(master=os.environ.get("TEST_MASTER", "local[*]"), shuffle_partitions=8, app_name="loomtext-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF0001
