import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session(**{"spark.sql.maxMetadataStringLength": "10000"})


@pytest.fixture
def series(spark):
    """Hourly readings of one column from a list of values."""

    def make(values, column="v", site=None, step_hours=1):
        start = datetime(2024, 1, 1)
        rows = [(start + timedelta(hours=i * step_hours), i, None if x is None else float(x)) for i, x in enumerate(values)]
        if site is None:
            return spark.createDataFrame(rows, f"timestamp timestamp_ntz, record_number bigint, {column} double")
        rows = [(*r, site[i]) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, f"timestamp timestamp_ntz, record_number bigint, {column} double, site string")

    return make
