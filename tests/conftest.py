import pytest

from foliora.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[2]", 2)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
