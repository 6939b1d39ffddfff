import pytest

from docloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(app="docloom-tests", memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
