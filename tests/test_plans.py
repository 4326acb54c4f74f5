"""Physical plans: pushed filters, and no raw rows gathered in one task."""

import re

import pytest
from pyspark.sql import functions as F

from envspark.operators import clean, scale, series as ops, topk
from envspark.operators.aggregate import daily_mean
from envspark.operators.align import common_dates


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("readings") / "t")
    spark.range(2000).selectExpr(
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS timestamp",
        "id AS record_number",
        "concat('S', id % 3) AS site",
        "CAST(id % 17 AS DOUBLE) AS ph",
        "CAST(id AS DOUBLE) AS other",
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_date_range_reaches_the_scan(table):
    text = plan(clean.in_date_range(table.select("timestamp", "ph"), "2024-01-01", "2024-01-01"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(timestamp,2024-01-01.*LessThan\(timestamp,2024-01-02", text)
    assert "other" not in re.findall(r"ReadSchema: (.*)", text)[-1]


def test_newest_days_reach_the_scan(table):
    text = plan(clean.last_days(table, 1))
    assert "GreaterThanOrEqual(timestamp,ScalarSubquery" in text


@pytest.mark.parametrize("site", [None, "site"])
def test_row_windows_are_split_into_blocks(table, site):
    for df in (
        ops.rolling(table, "ph", rows=7, site=site),
        ops.lag_features(table, "ph", site=site),
        ops.sequences(table, "ph", site=site),
        scale.carried(table, ["ph"], site=site),
    ):
        text = plan(df)
        physical = text[text.index("== Physical Plan ==") :]
        windows = re.findall(r"windowspecdefinition\(([a-z_]+)#", physical)
        # Raw rows are windowed by block; only one-row-per-partition tables may go without.
        assert windows and set(windows) <= {"_block", "_part", "site"}
        for spec in re.findall(r"windowspecdefinition\(site#\d+, (\w+)#", physical):
            assert spec == "_block"
        assert "CartesianProduct" not in physical


def test_top_rows_use_a_bounded_heap(table):
    for df in (scale.last_n(table, 30), topk.random_sample(table, 10)):
        assert "TakeOrderedAndProject" in plan(df)


def test_daily_means_combine_before_the_shuffle(table):
    physical = plan(daily_mean(table, ["ph"]))
    assert "partial_avg" in physical


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_results_do_not_depend_on_shuffle_partitions(spark, table, partitions):
    def answers():
        rolled = ops.rolling(table.repartition(5), "ph", rows=4, center=True, block_rows=64)
        kth = ops.every_kth(table.repartition(3), 50)
        split, _ = ops.chrono_split(table, 0.3)
        return (
            [r.rolling_mean for r in rolled.orderBy("record_number").collect()],
            sorted(r.record_number for r in kth.collect()),
            split.agg(F.max("record_number")).first()[0],
        )

    want = answers()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert answers() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert want[2] == 1399


def test_common_days_shuffle_days_and_not_rows(table):
    """A day that holds most rows goes to the shuffle once from a task; no join sees rows."""
    text = plan(common_dates(table, table.select(F.to_date("timestamp").alias("date"))))
    physical = text[text.index("== Physical Plan ==") :]
    assert "Join" not in physical
    assert re.search(r"Exchange hashpartitioning\(date.*\n[^\n]*HashAggregate\(keys=\[date", physical)
