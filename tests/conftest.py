import pytest

from ecoframe.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("ecoframe-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
