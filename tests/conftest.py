import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from seqloom.session import session

    os.environ.setdefault("SEQLOOM_DRIVER_MEMORY", "4g")
    found = session(4, 4)
    yield found
    found.stop()
