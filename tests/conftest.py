import pytest

from engram.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, app="engram-tests", spark__sql__autoBroadcastJoinThreshold="256k")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
