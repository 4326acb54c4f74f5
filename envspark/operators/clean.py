"""Coercion, capping and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..defaults import ORDER
from ..functions.numeric import clip, parse_number
from ..sources.catalog import numeric_columns, text_columns
from .quantiles import exact_quantiles
from .scale import carried, last_n, one_row


def coerce_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    strip_grouping: bool = False,
    min_parse_share: float = 0.0,
) -> DataFrame:
    """Text columns to double; what does not parse becomes NULL.

    By default every text column except dates, record numbers and quality flags
    is converted. With ``min_parse_share`` a column stays text unless at least
    that share of its non-null values parses (runs one aggregate).
    """
    columns = list(columns) if columns is not None else text_columns(df)
    parsed = {c: parse_number(F.col(f"`{c}`").cast("string"), strip_grouping) for c in columns if c in df.columns}
    if min_parse_share > 0 and parsed:
        row = df.agg(
            *[F.count(v).alias(f"ok_{i}") for i, v in enumerate(parsed.values())],
            *[F.count(f"`{c}`").alias(f"all_{i}") for i, c in enumerate(parsed)],
        ).first()
        parsed = {
            c: v for i, (c, v) in enumerate(parsed.items()) if row[f"ok_{i}"] >= min_parse_share * row[f"all_{i}"]
        }
    return df.withColumns(parsed)


def numbers_and_days(
    df: DataFrame, timestamp: str | None = None, min_parse_share: float = 0.5
) -> tuple[DataFrame, tuple]:
    """Columns as :func:`coerce_numeric` parses them, and the first and last day, both from one aggregate.

    Rows without a timestamp are counted, but left out.
    """
    parsed = {c: parse_number(F.col(f"`{c}`").cast("string")) for c in text_columns(df)}
    date = F.col(f"`{timestamp}`").cast("date") if timestamp else F.lit(None).cast("date")
    measures = [F.min(date).alias("first"), F.max(date).alias("last")]
    for i, (c, v) in enumerate(parsed.items()):
        measures += [F.count(v).alias(f"ok_{i}"), F.count(f"`{c}`").alias(f"all_{i}")]
    counts = df.agg(*measures).first()
    numeric = {c: v for i, (c, v) in enumerate(parsed.items()) if counts[f"ok_{i}"] >= min_parse_share * counts[f"all_{i}"]}
    rows = df.where(F.col(f"`{timestamp}`").isNotNull()) if timestamp else df
    return rows.withColumns(numeric) if numeric else rows, (counts["first"], counts["last"])


def cap_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    q: tuple[float, float] = (0.001, 0.999),
    mode: str = "exact",
) -> DataFrame:
    """Clamp each numeric column to its own quantiles; a column without values stays as it is.

    The bounds of all columns come from shared passes over the table (runs
    actions). ``mode="approx"`` takes them from one sketch pass.
    """
    columns = list(columns or numeric_columns(df))
    if mode == "exact":
        bounds = exact_quantiles(df, columns, q)
    else:
        bounds = dict(zip(columns, df.approxQuantile(columns, list(q), 1e-4)))
    return df.withColumns(
        {c: clip(F.col(c), F.lit(b[0]), F.lit(b[1])) for c, b in bounds.items() if b and b[0] is not None}
    )


def cap_and_fill(df: DataFrame, columns: Sequence[str] | None = None, tail: float = 0.001) -> DataFrame:
    """Cap outliers at the quantiles ``tail`` and ``1 - tail``, then fill gaps with the median.

    Capping both ends alike does not move the median, so one quantile search
    serves both steps.
    """
    columns = list(columns or numeric_columns(df))
    found = exact_quantiles(df, columns, (tail, 0.5, 1 - tail))
    return df.withColumns(
        {
            c: F.coalesce(clip(F.col(c), F.lit(low), F.lit(high)), F.lit(middle))
            for c, (low, middle, high) in found.items()
            if middle is not None
        }
    )


def impute(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "median",
    order: Sequence[str] = ORDER,
    site: str | None = None,
) -> DataFrame:
    """Fill missing numbers. ``method``: median, mean, ffill_bfill or zero."""
    columns = list(columns or numeric_columns(df))
    if method == "median":
        middle = exact_quantiles(df, columns, (0.5,))
        return df.fillna({c: m for c, (m,) in middle.items() if m is not None})
    if method == "mean":
        means = one_row(df.agg(*[F.avg(c).alias(c) for c in columns]))
        return df.withColumn("_means", means).withColumns(
            {c: F.coalesce(F.col(c), F.col(f"_means.{c}")) for c in columns}
        ).drop("_means")
    if method == "ffill_bfill":
        filled = carried(df, columns, order, site)
        return filled.select(
            *[F.coalesce(f"{c}_prev", f"{c}_next").alias(c) if c in columns else F.col(c) for c in df.columns]
        )
    if method == "zero":
        return df.fillna(0.0, subset=columns)
    raise ValueError(f"unknown imputation method: {method}")


def impute_recent(df: DataFrame, columns: Sequence[str], n: int = 2000, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest ``n`` rows, missing numbers filled with the median of those rows."""
    return impute(last_n(df, n, order), columns, "median")


def column_coverage(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Non-null share per column (runs one aggregate)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns]).first()
    return {c: row[c] / row["n"] if row["n"] else 0.0 for c in columns}


def covered_columns(df: DataFrame, columns: Sequence[str], min_share: float = 0.01) -> list[str]:
    """Columns whose non-null share reaches ``min_share`` (runs one aggregate)."""
    kept = [c for c, share in column_coverage(df, columns).items() if share >= min_share]
    if not kept:
        raise ValueError("no column reaches the minimum coverage")
    return kept


def in_date_range(df: DataFrame, start: str, end: str, column: str = "timestamp") -> DataFrame:
    """Rows on the calendar days ``start`` to ``end``, both included."""
    ts = F.col(column)
    first = F.lit(start).cast("date").cast("timestamp_ntz")
    after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return df.where((ts >= first) & (ts < after))


def last_days(df: DataFrame, days: int, column: str = "timestamp") -> DataFrame:
    """Rows within ``days`` days of the newest timestamp; the bound reaches the scan as a filter."""
    newest = df.agg((F.max(column) - F.expr(f"INTERVAL {int(days)} DAYS")).alias("cut"))
    return df.where(F.col(column) >= newest.scalar())


def out_of_limits(
    df: DataFrame,
    ph: tuple[float, float] = (6.5, 8.5),
    turbidity_quantile: float = 0.95,
    index_at_least: float = 60.0,
) -> dict[str, Column]:
    """Named threshold predicates of the monitoring pages (runs actions for the turbidity bound)."""
    (high,) = exact_quantiles(df, ["turbidity"], (turbidity_quantile,))["turbidity"]
    return {
        "ph_out": (F.col("ph") < ph[0]) | (F.col("ph") > ph[1]),
        "turbidity_high": F.col("turbidity") > F.lit(high),
        "index_ok": F.col("wqi") >= index_at_least,
        "do_ok": F.col("do_mgl") >= 5.0,
        "turbidity_ok": F.col("turbidity") <= 5.0,
        "conductance_ok": F.col("conductance") <= 1500.0,
    }


def monthly_climate(weather: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Mean and standard deviation of each column per month of the year."""
    return weather.where(F.col(date).isNotNull()).groupBy(F.month(date).alias("month")).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"{c}_std") for c in columns]
    )


def climatology_fill(
    weather: DataFrame, start: str | Column, end: str | Column, columns: Sequence[str], date: str = "date"
) -> DataFrame:
    """One row per day of the range with the usual value of its month.

    A month without data takes the overall mean; a month with a single value
    takes the overall deviation, at least 0.1. Means are not negative.
    """
    known = weather.where(F.col(date).isNotNull())
    months = monthly_climate(known, columns, date)
    overall = one_row(
        known.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"{c}_std") for c in columns])
    )
    first, final = (F.lit(x).cast("date") if isinstance(x, str) else x for x in (start, end))
    days = weather.sparkSession.range(1).select(F.explode(F.sequence(first, final)).alias(date))
    # Twelve months at most.
    joined = days.withColumn("month", F.month(date)).join(F.broadcast(months), "month", "left")
    joined = joined.withColumn("_all", overall)
    out = [F.col(date)]
    for c in columns:
        mean, std = F.col(f"{c}_mean"), F.col(f"{c}_std")
        spread = F.greatest(F.lit(0.1), F.col(f"_all.{c}_std"))
        out.append(F.greatest(F.lit(0.0), F.coalesce(mean, F.col(f"_all.{c}_mean"))).alias(c))
        out.append(
            F.when(mean.isNotNull(), F.coalesce(std, spread)).otherwise(F.col(f"_all.{c}_std")).alias(f"{c}_std")
        )
    return joined.select(*out, F.lit(True).alias("is_filled"))
