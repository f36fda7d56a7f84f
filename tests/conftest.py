import pytest

from millwatch.session import clear_staging, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    clear_staging(session)
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
