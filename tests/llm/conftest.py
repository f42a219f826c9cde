import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A shared folder for intermediate tables."""
    return spark
