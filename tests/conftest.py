import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewatch.plans.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    active = session("local[4]", 4)
    active.sparkContext.setLogLevel("ERROR")
    yield active
    active.stop()


@pytest.fixture(scope="session")
def sample(spark):
    from tidewatch.sources.sample import sample_sales

    return sample_sales(spark)
