"""From raw readings and weather to the scored, dated table every report reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..defaults import ORDER, SATURATION_PARAMETERS, SITE_NAMES, Parameter
from ..functions import calendar as cal
from ..functions.quality import CUTS, PARAMETERS, classify, combine, sub_index
from ..operators.align import join_daily, prefix_weather, weather_daily
from ..operators.clean import cap_and_fill, cap_outliers, climatology_fill, coerce_numeric, impute, numbers_and_days
from ..sources.catalog import numeric_columns
from ..sources.tables import drop_missing_time


def wqi(
    df: DataFrame,
    method: str = "deviation",
    params: Sequence[Parameter] | None = None,
    null_policy: str = "null",
    cuts: Sequence[float] | None = None,
    details: bool = True,
) -> DataFrame:
    """Adds the quality index, its class and (``details``) each parameter's score and contribution.

    Parameters whose column is absent are left out; the deviation index then
    divides by the weights that are there.
    """
    present = [p for p in (params or PARAMETERS[method]) if p.column in df.columns]
    scores = {p: sub_index(F.col(p.column), p, method) for p in present}
    contributions = [s * p.weight for p, s in scores.items()]
    index = combine(contributions, [p.weight for p in present], method, null_policy)
    added = {}
    if details:
        for (p, score), contribution in zip(scores.items(), contributions):
            added[f"{p.column}_q"] = score
            added[f"{p.column}_contrib"] = contribution
    added["wqi"] = index
    return df.withColumns(added).withColumn("wqi_class", classify(F.col("wqi"), cuts or CUTS[method]))


def calendar_features(
    df: DataFrame, col: str = "timestamp", include_hour: str | bool = "auto", autumn: str = "Autumn"
) -> DataFrame:
    """Year, month, weekday, weekend flag, day of year, season and hour.

    ``include_hour="auto"`` adds the hour only if more than one occurs (runs
    one aggregate). A missing column leaves the table as it is.
    """
    if col not in df.columns:
        return df
    ts = F.col(col)
    added = {
        "year": F.year(ts),
        "month": F.month(ts),
        "day_of_week": cal.weekday_name(ts),
        "day_of_week_num": cal.weekday_number(ts),
        "is_weekend": cal.is_weekend(ts),
        "day_of_year": F.dayofyear(ts),
        "season": cal.season(F.month(ts), autumn),
    }
    if include_hour == "auto":
        low, high = df.agg(F.min(F.hour(ts)), F.max(F.hour(ts))).first() if dict(df.dtypes)[col] != "date" else (0, 0)
        include_hour = low != high
    if include_hour:
        added["hour"] = F.hour(ts)
    return df.withColumns(added)


def enrich(
    readings: DataFrame,
    weather: DataFrame | None = None,
    cap: bool = True,
    impute_method: str | None = "median",
    calendar: bool = True,
    fill_weather: bool = True,
    wqi_method: str = "deviation",
    null_policy: str = "null",
    order: Sequence[str] = ORDER,
    include_hour: str | bool = True,
) -> DataFrame:
    """Coerce, join weather, cap, impute, score and date the readings; every step can be left out.

    Text columns become numbers where at least half of their values are. Rows
    without a timestamp are left out. One aggregate of each table finds both
    what is a number and which days there are.

    Weather that shares no date range with the readings is replaced by the
    usual values of each month (``fill_weather``).
    """
    df, days = numbers_and_days(readings, order[0] if order[0] in readings.columns else None)
    if weather is not None:
        parsed, weather_days = numbers_and_days(weather, "date")
        daily = weather_daily(parsed)
        if fill_weather:
            daily = _cover(daily, days, weather_days)
        df = join_daily(df, prefix_weather(daily), order[0])
    # A site may be a number, but it is a name.
    numbers = [c for c in numeric_columns(df) if c not in order and c not in SITE_NAMES]
    if cap and impute_method == "median":
        df = cap_and_fill(df, numbers)
    else:
        df = cap_outliers(df, numbers) if cap else df
        df = impute(df, numbers, impute_method, order) if impute_method else df
    df = wqi(df, wqi_method, null_policy=null_policy)
    return calendar_features(df, order[0], include_hour) if calendar else df


def process_readings(readings: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The batch preset: capped and filled readings with the gaussian index on oxygen saturation, and "Fall" for autumn."""
    df = drop_missing_time(coerce_numeric(readings, min_parse_share=0.5), order[0])
    numbers = [c for c in numeric_columns(df) if c not in order and c not in SITE_NAMES]
    scored = wqi(cap_and_fill(df, numbers), "gaussian", SATURATION_PARAMETERS)
    return calendar_features(scored, order[0], autumn="Fall")


def _cover(daily: DataFrame, days: tuple, weather_days: tuple) -> DataFrame:
    """The weather, or usual values over ``days`` if it has none of these (first and last of each)."""
    (first, last), (since, until) = days, weather_days
    if first is None or since is None or not (until < first or since > last):
        return daily
    columns = [c for c in numeric_columns(daily) if c != "seq"]
    filled = climatology_fill(daily, F.lit(first), F.lit(last), columns)
    return filled.drop(*[f"{c}_std" for c in columns], "is_filled").withColumn("rain_filled", F.lit(True))


def process_weather(weather: DataFrame, calendar: bool = True, autumn: str = "Fall") -> DataFrame:
    """Weather with numeric columns and calendar parts."""
    text = [c for c, t in weather.dtypes if t == "string" and c not in ("date", "weather_condition")]
    df = coerce_numeric(weather, text)
    return calendar_features(df, "date", autumn=autumn) if calendar else df
