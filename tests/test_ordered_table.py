"""An ordered table answers by position and time from the files that hold the rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from envspark.operators import series as ops
from envspark.operators.scale import last_n
from envspark.sources.ordered_table import OrderedTable

START = datetime(2024, 1, 1)
SCHEMA = "timestamp timestamp_ntz, record_number long, v double, file string, place int, before int, position int"


def readings(spark, n=700, undated=9):
    rows = [(None if i < undated else START + timedelta(minutes=(i * 37) % 500), i, None if i % 11 == 0 else float(i), f"f{i}", i, -i, 2 * i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = readings(spark).cache()
    return df, OrderedTable.write(df, f"{tmp_path_factory.mktemp('ordered')}/t", file_rows=60)


def numbers(df):
    return sorted(r["record_number"] for r in df.select("record_number").collect())


def in_order(df):
    return [r["record_number"] for r in df.orderBy(F.col("timestamp").asc_nulls_first(), "record_number").collect()]


def test_positions_follow_the_order_and_columns_of_any_name_stay(stored):
    df, table = stored
    got = table.positions("at").orderBy("at").collect()
    assert [r["record_number"] for r in got] == in_order(df)
    assert [r["at"] for r in got] == list(range(700))
    assert all(r["file"] == f"f{r['record_number']}" and r["place"] == r["record_number"] == -r["before"] == r["position"] / 2 for r in got)
    assert table.count() == 700


@pytest.mark.parametrize("n", [0, 59, 695, 5000])
def test_first_and_newest_rows(stored, n):
    df, table = stored
    assert numbers(table.newest(n)) == numbers(last_n(df, n))
    assert numbers(table.first(n)) == sorted(in_order(df)[:n])


@pytest.mark.parametrize("k", [0, 9, 333, 700])
def test_kth_row_and_the_rows_before_it(stored, k):
    df, table = stored
    order = in_order(df)
    assert numbers(table.kth(k)) == order[k : k + 1]
    assert numbers(table.rows().where(table.before(k))) == sorted(order[:k])


@pytest.mark.parametrize("target", [1, 100, 2000])
def test_every_kth_row(stored, target):
    df, table = stored
    assert sorted(map(tuple, table.every_kth(target, "at").select("at", "record_number").collect())) == sorted(
        map(tuple, ops.every_kth(df.drop("position"), target).select("position", "record_number").collect())
    )


def test_split_and_range_of_time(stored):
    df, table = stored
    for got, want in zip(table.chrono_split(0.3), ops.chrono_split(df, 0.3)):
        assert numbers(got) == numbers(want)
    low, high = START + timedelta(minutes=100), START + timedelta(minutes=140)
    assert numbers(table.between(low, high)) == numbers(df.where((F.col("timestamp") >= F.lit(low)) & (F.col("timestamp") < F.lit(high))))


def test_only_files_that_hold_the_rows_are_opened(stored):
    _, table = stored
    total = table.manifest().count()
    with pytest.raises(ValueError):
        table.every_kth(3, "position")
    assert total >= 10

    def opened(part):
        return sum("/rows/" in f for f in part.inputFiles())

    assert opened(table.newest(5)) == 1
    assert opened(table.kth(350)) == 1
    assert opened(table.every_kth(3, "at")) <= 4
    assert opened(table.between(START, START + timedelta(minutes=20))) < total / 2
    # Rows that enter the last task are those of the opened file, not n from every task.
    assert table.newest(5).count() == 5


def test_an_empty_table_and_an_unfinished_one(spark, tmp_path):
    empty = OrderedTable.write(readings(spark).where("v = -1"), f"{tmp_path}/e")
    assert empty.count() == 0 and empty.positions("at").count() == 0
    for part in (empty.newest(3), empty.kth(0), empty.every_kth(5, "at"), *empty.chrono_split()):
        assert part.count() == 0 and part.columns[:2] == ["timestamp", "record_number"]
    readings(spark, 20).write.parquet(f"{tmp_path}/broken/rows")
    with pytest.raises(FileNotFoundError):
        OrderedTable(spark, f"{tmp_path}/broken").count()


def test_undated_rows_alone(spark, tmp_path):
    df = readings(spark, 40, undated=40)
    table = OrderedTable.write(df, f"{tmp_path}/u", file_rows=7)
    assert numbers(table.newest(3)) == [37, 38, 39]
    assert numbers(table.rows().where(table.before(5))) == [0, 1, 2, 3, 4]
