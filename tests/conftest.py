import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from sievelake.session import local_session, ship

    found = local_session(cores=4, memory="4g", partitions=4)
    ship(found)
    return found


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
