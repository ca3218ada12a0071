import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tapewise.session import local_session, release_shared   # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8, "4g", 4)


@pytest.fixture(autouse=True)
def clean():
    yield
    release_shared()
