import pytest

from plinth.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("plinth-tests", "4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
