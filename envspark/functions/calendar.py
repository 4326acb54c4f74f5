"""Calendar parts of a timestamp or date column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..defaults import MONTHS, WEEKDAYS


def day(ts: Column) -> Column:
    return ts.cast("date")


def weekday_number(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def _name(names: Sequence[str], place: Column) -> Column:
    """Name at a 1-based place; the guard is needed because element_at of a literal array ignores a NULL place."""
    return F.when(place.isNotNull(), F.element_at(F.array(*map(F.lit, names)), place))


def weekday_name(ts: Column) -> Column:
    return _name(WEEKDAYS, F.weekday(ts) + 1)


def month_label(month: Column) -> Column:
    return _name(MONTHS, month)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def season(month: Column, autumn: str = "Autumn") -> Column:
    """Northern-hemisphere season; December opens winter. NULL stays NULL."""
    return _name(("Winter", "Spring", "Summer", autumn), (F.pmod(month, F.lit(12)) / 3).cast("int") + 1)


def month_period(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour periods between two timestamps."""
    return F.floor((micros(end) - micros(start)) / 86_400_000_000)


def ordinal(ts: Column) -> Column:
    """Day number counted from 0001-01-01 as day 1."""
    return F.datediff(day(ts), F.lit("0001-01-01").cast("date")) + 1


def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the wall clock of a zone-free timestamp."""
    days = F.datediff(day(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = (days * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
