import pytest

from corpuslens.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"
