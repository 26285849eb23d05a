import pytest

from tracewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
