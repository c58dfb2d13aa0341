import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from footfall.session import local_session

    return local_session("4", 4)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
