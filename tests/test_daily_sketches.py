"""Quantiles of a range of days from stored sketches: exact, one pass, and right with sketches that are out of date."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from envspark.functions.numeric import bounded
from envspark.operators.quantiles import bracketed_quantiles
from envspark.sources.daily_sketches import DailySketches

START = datetime(2024, 1, 1)
PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def readings(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(6000):
        x = float(rng.lognormal())
        rows.append((None if i % 700 == 3 else START + timedelta(minutes=13 * i), i, None if i % 9 == 0 else float("nan") if i % 50 == 1 else x, 7.0 if i % 3 else float(i % 4), None))
    path = f"{tmp_path_factory.mktemp('readings')}/t"
    spark.createDataFrame(rows, "timestamp timestamp_ntz, record_number long, x double, steps double, none double").write.parquet(path)
    return spark.read.parquet(path)


def plain(df, column, start, end):
    rows = df.select("timestamp", column).collect()
    kept = [r[1] for r in rows if r[0] and start <= r[0].date() <= end and r[1] is not None and r[1] == r[1]]
    return [float(v) for v in np.quantile(kept, PROBABILITIES)] if kept else [None] * len(PROBABILITIES)


def check(got, df, start, end):
    for c, answers in got.items():
        want = plain(df, c, start, end)
        assert answers == pytest.approx(want, rel=1e-12) if want[0] is not None else answers == want


def sketches(spark, path, df, columns=("x", "steps", "none")):
    made = DailySketches(spark, str(path), columns)
    made.update(df.where("record_number % 2 = 0"), 1)
    for _ in range(2):  # delivered twice
        made.update(df.where("record_number % 2 = 1"), 2)
    return made


@pytest.mark.parametrize("days", [(0, 100), (3, 9), (80, 90)])
@pytest.mark.parametrize("limit", [40, 20_000])
def test_any_range_is_exact(spark, readings, tmp_path, days, limit):
    start, end = (date(2024, 1, 1) + timedelta(days=d) for d in days)
    made = sketches(spark, tmp_path, readings)
    check(made.quantiles(readings, PROBABILITIES, start, end, limit), readings, start, end)


def test_sketches_that_miss_readings_or_know_too_many(spark, readings, tmp_path):
    few = DailySketches(spark, f"{tmp_path}/few", ["x", "steps"])
    few.update(readings.where("x < 0.5"), 1)
    span = date(2024, 1, 1), date(2024, 3, 1)
    check(few.quantiles(readings, PROBABILITIES, *span), readings, *span)
    many = sketches(spark, f"{tmp_path}/many", readings.withColumn("x", F.col("x") * 100), ["x"])
    check(many.quantiles(readings, PROBABILITIES, *span), readings, *span)
    none = DailySketches(spark, f"{tmp_path}/none", ["x"])
    check(none.quantiles(readings, PROBABILITIES, *span), readings, *span)


def test_without_readings(spark, readings, tmp_path):
    made = sketches(spark, tmp_path, readings, ["x"])
    assert made.quantiles(readings.where("record_number < 0"), [0.5]) == {"x": [None]}
    assert made.quantiles(readings, [0.5], date(1999, 1, 1), date(1999, 2, 1)) == {"x": [None]}


def test_the_readings_are_read_once(spark, readings, tmp_path):
    made = sketches(spark, tmp_path, readings, ["x"])
    ends = {"x": made.brackets([0.25, 0.5, 0.75])[0]}
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    counted = F.udf(count, "double").asNondeterministic()
    # Every pass over the readings calls the function once a row.
    rows = readings.withColumn("y", counted("x")).select("y")
    total = readings.count()
    got = bracketed_quantiles(rows, {"x": bounded(F.col("y"))}, [0.25, 0.5, 0.75], ends)
    assert seen.value == total
    want = [r for r in plain(readings.withColumn("timestamp", F.lit(START)), "x", date(2000, 1, 1), date(2100, 1, 1))]
    assert got["x"] == pytest.approx(want[2:5], rel=1e-12)
