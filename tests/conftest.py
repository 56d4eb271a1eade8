import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from faultline.session import MAX_GROUP_ROWS, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def tight(spark):
    """Every group above 40 rows counts as hot, so the sliced plans are used."""
    spark.conf.set(MAX_GROUP_ROWS, "40")
    yield spark
    spark.conf.unset(MAX_GROUP_ROWS)
