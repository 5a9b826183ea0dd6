import pytest

from scrivan.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("4", **{"spark__sql__shuffle__partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    return s
