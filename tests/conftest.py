import pytest

from tidelog.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", "local[4]", 4)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
