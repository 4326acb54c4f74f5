"""Joins with a long daily side and samples by hash: whole results, and no task that gets most of the work."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from envspark.operators import align, scale, topk

DAY = date(2024, 1, 1)


@pytest.fixture(scope="module")
def readings(spark, tmp_path_factory):
    def at(i):
        if i % 10 == 9:
            return None
        return datetime(2024, 1, 1) + (timedelta(days=40, seconds=i) if i % 2 else timedelta(days=i % 401, seconds=i))

    rows = [(at(i), i, float(i), i, "x") for i in range(20_000)]
    path = f"{tmp_path_factory.mktemp('spread')}/t"
    spark.createDataFrame(rows, "timestamp timestamp_ntz, record_number long, v double, _piece int, _count string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def daily(spark):
    # Some days of the readings have no weather, and some weather no readings.
    return spark.createDataFrame([(DAY + timedelta(days=d), float(d), None if d % 3 else d) for d in range(30, 600)], "date date, rain double, _pieces int")


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_spread_join_equals_the_broadcast_join(readings, daily):
    spread, plain = align.join_daily(readings, daily, max_days=1), align.join_daily(readings, daily)
    assert spread.columns == plain.columns and spread.dtypes == plain.dtypes
    assert rows(spread) == rows(plain)
    assert align.join_daily(readings.limit(0), daily, max_days=1).count() == 0
    assert align.join_daily(readings, daily.limit(0), max_days=-1).where("rain IS NULL").count() == 20_000


def test_a_day_of_half_the_rows_is_no_large_task(spark, readings, daily):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = align.join_daily(readings, daily, max_days=1)
        dated = joined.where("date IS NOT NULL").groupBy(F.spark_partition_id().alias("p")).count()
        sizes = sorted(r["count"] for r in dated.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 18_000
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("n", [0, 1, 137, 9_999, 20_000, 30_000])
def test_least_tickets_are_those_of_a_full_sort(readings, n):
    # A third of the rows share one key, some have none.
    df = readings.select("record_number", F.when(F.col("record_number") % 3 == 0, 7).when(F.col("record_number") % 50 != 1, F.col("record_number")).alias("k"))
    ticket = F.xxhash64("k")
    known = df.withColumn("t", F.when(F.col("k").isNotNull(), ticket))
    got = scale.least_tickets(known, n, F.col("t"), F.shiftright("t", 32), "record_number")
    want = known.orderBy("t", "record_number").limit(n)
    assert rows(got) == rows(want)


def test_few_rows_are_sorted_for_a_sample(readings):
    sample = topk.random_sample(readings, 50)
    ticket = F.md5(F.col("record_number").cast("string"))
    assert rows(sample) == rows(readings.orderBy(ticket, "record_number").limit(50))
    tree = sample._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" in tree and "scalar-subquery" in tree
