import pytest

from cairnflow.plans.session import session, ship


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
