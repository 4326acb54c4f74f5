"""Every registered query with SQL equals it on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["wqi_bands_known", "volatility_known", "kpis_with_rain", "scan_metrics"])
def test_every_column_has_values(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    filled = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns]).first().asDict()
    assert [c for c, n in filled.items() if n == 0] == []


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
