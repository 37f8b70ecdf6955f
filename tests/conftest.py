import tempfile

import pytest

from corrobora.session import build_session


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="corrobora-")
    session = build_session(
        "tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
        spark__sql__warehouse__dir=scratch, spark__sql__autoBroadcastJoinThreshold="10485760")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
