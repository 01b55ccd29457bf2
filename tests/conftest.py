import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loomwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "8g")
    yield session
    session.stop()


@pytest.fixture()
def small_groups(spark):
    """Every group above a handful of rows takes the chunked forms."""
    spark.conf.set("spark.loomwright.groupRowLimit", "4")
    yield
    spark.conf.unset("spark.loomwright.groupRowLimit")
