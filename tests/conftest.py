import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from paperloom.session import local_session

    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
