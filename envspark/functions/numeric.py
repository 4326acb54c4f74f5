"""Null-safe arithmetic and parsing of numbers held as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(value: Column) -> Column:
    """NaN marks a missing value in sensor exports; here missing is NULL."""
    return F.when(~F.isnan(value), value)


def bounded(value: Column) -> Column:
    """NULL for NaN and for both infinities."""
    return F.when(F.abs(finite(value)) < float("inf"), value)


def parse_number(text: Column, strip_grouping: bool = False) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    if strip_grouping:
        text = F.nullif(F.regexp_replace(text, ",", ""), F.lit(""))
    return finite(text.try_cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL where the denominator is zero."""
    return top / F.nullif(bottom.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part.cast("double") * 100.0, whole)


def clip(value: Column, low: Column, high: Column) -> Column:
    """Clamp, keeping NULL as NULL; a NULL bound leaves that end open."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def population_to_sample_skewness(skewness: Column, n: Column) -> Column:
    """Bias-corrected skewness from Spark's population skewness."""
    return ratio(skewness * F.sqrt(n * (n - 1)), n - 2)


def population_to_sample_kurtosis(kurtosis: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from Spark's population excess kurtosis."""
    return ratio((n - 1) * ((n + 1) * kurtosis + 6), (n - 2) * (n - 3))
