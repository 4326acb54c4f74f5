"""Bringing readings and daily weather together by date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from ..defaults import WEEKDAYS
from ..functions import calendar as cal
from ..functions.numeric import percent
from ..functions.text import weather_name
from .scale import BROADCAST_ROWS, one_row, spread_left_join, written


def weather_daily(
    weather: DataFrame, date: str = "date", order: Sequence[str] = ("seq",), numeric_agg: str = "avg"
) -> DataFrame:
    """One row per day: rainfall summed, other numbers averaged (or summed), first text by ``order``.

    Rows without a date are dropped before grouping.
    """
    order = [c for c in order if c in weather.columns]
    aggregates = []
    for field in weather.schema:
        name = field.name
        if name == date or name in order:
            continue
        if isinstance(field.dataType, NumericType):
            total = name.lower() == "rainfall" or numeric_agg == "sum"
            aggregates.append((F.sum if total else F.avg)(F.col(name).cast("double")).alias(name))
        elif order:
            aggregates.append(F.min_by(name, F.when(F.col(name).isNotNull(), F.struct(*order))).alias(name))
        else:
            aggregates.append(F.min(name).alias(name))
    return (
        weather.where(F.col(date).isNotNull())
        .groupBy(F.col(date).cast("date").alias("date"))
        .agg(*aggregates)
    )


def prefix_weather(daily: DataFrame) -> DataFrame:
    """Weather names that cannot clash with sensor names."""
    return daily.withColumnsRenamed({c: weather_name(c) for c in daily.columns})


def join_daily(readings: DataFrame, daily: DataFrame, timestamp: str = "timestamp", max_days: int = BROADCAST_ROWS) -> DataFrame:
    """Readings with their day's weather; every reading is kept.

    The daily side has one row per date. It is written once (an action) and
    broadcast if it has at most ``max_days`` rows, so a day that holds most readings
    does not gather in one task and later passes do not aggregate it again.
    A longer one is joined by a shuffle that spreads frequent days and leaves
    readings without a date where they are.
    """
    days = written(daily, "daily")
    dated = readings.withColumn("date", cal.day(F.col(timestamp)))
    if days.count() <= max_days:
        return dated.join(F.broadcast(days), "date", "left")
    return spread_left_join(dated, days, "date")


def overlap(a: DataFrame, b: DataFrame, a_col: str = "timestamp", b_col: str = "date") -> DataFrame:
    """Date range of both inputs and whether they miss each other."""
    def span(df, c, name):
        return df.agg(F.min(cal.day(F.col(c))).alias(f"{name}_min"), F.max(cal.day(F.col(c))).alias(f"{name}_max"))

    return (
        span(a, a_col, "a")
        .withColumn("_b", one_row(span(b, b_col, "b")))
        .select("a_min", "a_max", "_b.b_min", "_b.b_max")
        .withColumn("disjoint", (F.col("b_max") < F.col("a_min")) | (F.col("b_min") > F.col("a_max")))
    )


def align_ranges(
    a: DataFrame, b: DataFrame, a_col: str = "timestamp", b_col: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """Both inputs cut to the calendar days they have in common (range, both ends included)."""
    both = overlap(a, b, a_col, b_col)
    low = both.select(F.greatest("a_min", "b_min")).scalar()
    high = both.select(F.least("a_max", "b_max")).scalar()

    def cut(df, c):
        if dict(df.dtypes)[c] in ("timestamp_ntz", "date"):  # the bare column, so that the range reaches the scan
            kind = dict(df.dtypes)[c]
            return df.where((F.col(c) >= low.cast(kind)) & (F.col(c) < F.date_add(high, 1).cast(kind)))
        return df.where((cal.day(F.col(c)) >= low) & (cal.day(F.col(c)) <= high))

    return cut(a, a_col), cut(b, b_col)


def common_dates(a: DataFrame, b: DataFrame, a_col: str = "timestamp", b_col: str = "date") -> DataFrame:
    """Calendar days present in both inputs.

    Tasks fold their rows to days before the shuffle, so no task gets the rows
    of a day (``intersect`` joins the rows first).
    """
    sides = [df.select(cal.day(F.col(c)).alias("date"), F.lit(first).alias("_first")) for df, c, first in ((a, a_col, True), (b, b_col, False))]
    days = sides[0].unionAll(sides[1]).where("date IS NOT NULL").groupBy("date")
    return days.agg(F.bool_or("_first").alias("_a"), F.bool_or(~F.col("_first")).alias("_b")).where("_a AND _b").select("date")


def date_coverage(a: DataFrame, b: DataFrame, a_col: str = "timestamp", b_col: str = "date") -> DataFrame:
    """Days spanned by each input, days in common and their share of the shorter span."""
    days = common_dates(a, b, a_col, b_col).agg(F.count(F.lit(1)).alias("common_days"))
    spans = overlap(a, b, a_col, b_col).select(
        (F.datediff("a_max", "a_min") + 1).cast("bigint").alias("a_days"),
        (F.datediff("b_max", "b_min") + 1).cast("bigint").alias("b_days"),
    )
    return spans.withColumn("common_days", days.scalar()).withColumn(
        "coverage_pct", percent(F.col("common_days"), F.least("a_days", "b_days"))
    )


def weekday_dimension(spark) -> DataFrame:
    """Seven rows: day number (Monday 0) and name."""
    return spark.createDataFrame(list(enumerate(WEEKDAYS)), "day_num int, day_name string")


def complete_weekdays(aggregated: DataFrame) -> DataFrame:
    """All seven weekdays in order, NULL where ``aggregated`` (keyed by day_num) has none."""
    dimension = F.broadcast(weekday_dimension(aggregated.sparkSession))
    return dimension.join(aggregated, "day_num", "left")
