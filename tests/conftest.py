import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from depthline.session import local_session

    session = local_session("tests", "4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
