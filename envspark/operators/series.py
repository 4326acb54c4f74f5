"""Ordered series: rolling statistics, lags, sequences, interpolation, decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..defaults import ORDER
from ..functions import calendar as cal
from .aggregate import daily_mean
from .clean import last_days
from .quantiles import first_rows
from .scale import blocked_window, last_n, order_key, recency, with_position


def centred_frame(rows: int) -> tuple[int, int]:
    """Rows before and after the current one in a centred frame of ``rows``."""
    after = (rows - 1) // 2
    return rows - 1 - after, after


def _full(value: Column, column: str, frame, rows: int) -> Column:
    """``value`` where the frame holds ``rows`` non-null values."""
    return F.when(F.count(column).over(frame) == rows, value)


def rolling(
    df: DataFrame,
    column: str,
    rows: int,
    center: bool = False,
    stats: Sequence[str] = ("mean",),
    order: Sequence[str] = ORDER,
    site: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Rolling mean and/or std over ``rows`` readings, NULL unless all of them are known."""
    functions = {"mean": F.avg, "std": F.stddev_samp}
    sites = [site] if site else []
    slim = df.select(*sites, *order, column)
    before, after = centred_frame(rows) if center else (rows - 1, 0)

    def columns(window):
        frame = window.rowsBetween(-before, after)
        return {f"rolling_{s}": _full(functions[s](column).over(frame), column, frame, rows) for s in stats}

    return blocked_window(slim, columns, before, after, order, site, block_rows)


def wqi_bands(
    df: DataFrame, rows: int = 7, z: float = 1.96, column: str = "wqi", order: Sequence[str] = ORDER
) -> DataFrame:
    """Centred rolling mean with bands of ``z`` rolling standard deviations."""
    rolled = rolling(df, column, rows=rows, center=True, stats=("mean", "std"), order=order)
    return rolled.withColumns(
        {
            "upper": F.col("rolling_mean") + z * F.col("rolling_std"),
            "lower": F.col("rolling_mean") - z * F.col("rolling_std"),
        }
    )


def volatility(df: DataFrame, rows: int = 30, column: str = "wqi", order: Sequence[str] = ORDER) -> DataFrame:
    return rolling(df, column, rows=rows, stats=("std",), order=order)


def rolling_days(
    df: DataFrame, column: str, days: int, stats: Sequence[str] = ("mean",), timestamp: str = "timestamp", site: str | None = None
) -> DataFrame:
    """Mean and/or std over all readings of each known day and the ``days - 1`` calendar days before it.

    Readings are summed up per day first, so the windows run over one row per
    day and a busy day costs no more than a quiet one. A day whose window holds
    no value has NULL (one value: NULL std); readings without timestamp belong
    to no day.
    """
    sites = [site] if site else []
    daily = (
        df.where(F.col(timestamp).isNotNull())
        .groupBy(*sites, cal.day(F.col(timestamp)).alias("day"))
        .agg(F.count(column).alias("_n"), F.avg(column).alias("_m"), F.var_samp(column).alias("_v"))
    )
    frame = Window.partitionBy(*sites).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    n = F.sum("_n").over(frame)
    mean = F.sum(F.col("_n") * F.col("_m")).over(frame) / F.nullif(n, F.lit(0))
    # Squares inside the days, and those of the day means around the mean of the window.
    within = F.coalesce(F.sum((F.col("_n") - 1) * F.coalesce("_v", F.lit(0.0)) * F.sign("_n")).over(frame), F.lit(0.0))
    known = F.collect_list(F.when(F.col("_n") > 0, F.struct("_n", "_m"))).over(frame)
    between = F.aggregate(known, F.lit(0.0), lambda total, d: total + d["_n"] * F.pow(d["_m"] - mean, F.lit(2.0)))
    std = F.when(n > 1, F.sqrt((within + between) / F.nullif(n - 1, F.lit(0))))
    made = {"mean": mean, "std": std}
    return daily.select(*sites, "day", *[made[s].alias(f"rolling_{s}") for s in stats])


def lag_features(
    df: DataFrame,
    target: str,
    lags: int = 2,
    order: Sequence[str] = ORDER,
    site: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Previous values of the target in row order."""
    def columns(window):
        return {f"{target}_lag_{k}": F.lag(target, k).over(window) for k in range(1, lags + 1)}

    return blocked_window(df, columns, lags, 0, order, site, block_rows).drop("position")


def class_transitions(
    df: DataFrame, column: str = "wqi_class", order: Sequence[str] = ORDER, site: str | None = None, block_rows: int | None = None
) -> DataFrame:
    """``source, target, rows``: how often one class follows another in row order; the first row follows none.

    NULL is a class of its own.
    """
    sites = [site] if site else []
    # A struct tells a NULL class from the lack of a row before.
    slim = df.select(*sites, *order, F.struct(F.col(column).alias("c")).alias("at"))
    followed = lag_features(slim, "at", 1, order, site, block_rows).where(F.col("at_lag_1").isNotNull())
    return followed.groupBy(F.col("at_lag_1.c").alias("source"), F.col("at.c").alias("target")).agg(F.count(F.lit(1)).alias("rows"))


def sequences(
    df: DataFrame,
    column: str,
    length: int = 10,
    order: Sequence[str] = ORDER,
    site: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """For each known value the ``length`` known values before it, oldest first."""
    sites = [site] if site else []
    known = df.where(F.col(column).isNotNull()).select(*sites, *order, column)

    def columns(window):
        return {"sequence": F.collect_list(column).over(window.rowsBetween(-length, -1))}

    made = blocked_window(known, columns, length, 0, order, site, block_rows)
    return made.where(F.size("sequence") == length).withColumnRenamed(column, "next_value").drop("position")


# ---------------------------------------------------------------- daily series


def _daily_window(site: str | None):
    return Window.partitionBy(*([site] if site else [])).orderBy("day")


def _growing(site: str | None):
    """Frames from either end of the daily series up to the current day."""
    sites = [site] if site else []
    return tuple(
        Window.partitionBy(*sites).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        for key in (F.asc("day"), F.desc("day"))
    )


def interpolate_daily(daily: DataFrame, column: str, site: str | None = None) -> DataFrame:
    """Linear between known days; nothing before the first, the last known value after the last."""
    back, ahead = _growing(site)
    known_day = F.when(F.col(column).isNotNull(), F.col("day"))
    around = daily.select(
        "*",
        F.last(column, ignorenulls=True).over(back).alias("_y0"),
        F.last(known_day, ignorenulls=True).over(back).alias("_d0"),
        F.last(column, ignorenulls=True).over(ahead).alias("_y1"),
        F.last(known_day, ignorenulls=True).over(ahead).alias("_d1"),
    )
    step = F.datediff("day", "_d0") / F.nullif(F.datediff("_d1", "_d0"), F.lit(0))
    value = (
        F.when(F.col("_d0").isNull() | F.col(column).isNotNull(), F.col(column))
        .when(F.col("_d1").isNull(), F.col("_y0"))
        .otherwise(F.col("_y0") + (F.col("_y1") - F.col("_y0")) * step)
    )
    return around.withColumn(column, value).drop("_y0", "_d0", "_y1", "_d1")


def trailing_mean(daily: DataFrame, column: str, span: int = 7, site: str | None = None) -> DataFrame:
    """Trailing mean over ``span`` days, or over the whole series if it is shorter."""
    w = _daily_window(site)
    size = F.least(F.lit(span), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    frame = w.rowsBetween(-(span - 1), 0)
    mean = F.when(F.count(column).over(frame) == size, F.avg(column).over(frame))
    return daily.withColumn("trailing_mean", mean)


def daily_series(
    df: DataFrame, column: str, span: int = 7, interpolate: bool = True, site: str | None = None
) -> DataFrame:
    """Daily mean of one parameter (optionally interpolated) with its trailing mean."""
    daily = daily_mean(df.where(F.col(column).isNotNull()), [column], site=site)
    if interpolate:
        daily = interpolate_daily(daily, column, site)
    return trailing_mean(daily, column, span, site)


def decompose(df: DataFrame, column: str, period: int = 7, site: str | None = None, min_days: int | None = None) -> DataFrame:
    """Additive decomposition of the daily mean into trend, seasonal and residual.

    Gaps are filled with the day before, then the day after. A series shorter
    than two periods gives no rows. All windows run over one row per day.
    """
    w = _daily_window(site)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back, ahead = _growing(site)
    previous = F.last(column, ignorenulls=True).over(back)
    following = F.last(column, ignorenulls=True).over(ahead)
    observed = daily_mean(df, [column], site=site).select(
        "*",
        F.coalesce(previous, following).alias("observed"),
        (F.row_number().over(w) - 1).alias("_i"),
        F.count(F.lit(1)).over(whole).alias("_n"),
    )
    half = period // 2
    wide = w.rowsBetween(-half, half)
    total = F.sum("observed").over(wide)
    if period % 2 == 0:
        # The two end rows of an even period count half each.
        total = total - (F.lag("observed", half).over(w) + F.lead("observed", half).over(w)) / 2
    # With an odd period the frame holds ``period`` rows, with an even one ``period + 1``.
    trend = F.when(F.count("observed").over(wide) == 2 * half + 1, total / period)
    sites = [site] if site else []
    slot = Window.partitionBy(*sites, "_slot")
    parts = (
        observed.where(F.col("_n") >= (min_days or 2 * period))
        .withColumn("trend", trend)
        .withColumn("_slot", F.pmod("_i", F.lit(period)))
        .withColumn("_s", F.avg(F.col("observed") - F.col("trend")).over(slot))
    )
    # The centre is the plain mean of the slot means, so each slot counts once.
    once = F.when(F.col("_i") < period, F.col("_s"))
    centre = F.avg(once).over(Window.partitionBy(*sites))
    return (
        parts.withColumn("seasonal", F.col("_s") - centre)
        .withColumn("residual", F.col("observed") - F.col("trend") - F.col("seasonal"))
        .select(*sites, "day", "observed", "trend", "seasonal", "residual")
    )


# ---------------------------------------------------------------- ends of the series


def latest_per_site(df: DataFrame, site: str, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest row of each site: an aggregate with map-side combine, not a window."""
    others = [c for c in df.columns if c != site]
    newest = df.groupBy(site).agg(F.max_by(F.struct(*others), order_key(order)).alias("_r"))
    return newest.select(site, *[F.col(f"_r.{c}").alias(c) for c in others])


def first_last_delta(df: DataFrame, column: str = "wqi", days: int = 7, order: Sequence[str] = ORDER) -> DataFrame:
    """Newest minus oldest value of the newest ``days`` days, and its direction."""
    ends = last_days(df, days).agg(
        F.min_by(column, order_key(order)).alias("first"), F.max_by(column, order_key(order)).alias("last")
    )
    delta = F.col("last") - F.col("first")
    direction = F.when(delta > 0, "rising").when(delta < 0, "falling").when(delta == 0, "stable")
    return ends.select("first", "last", delta.alias("delta"), direction.alias("direction"))


def trend_7v7(df: DataFrame, column: str = "wqi", rows: int = 7, order: Sequence[str] = ORDER) -> DataFrame:
    """Mean of the newest ``rows`` rows minus the mean of those before; 0 for a shorter table."""
    ranked = last_n(df.select(*order, column), 2 * rows, order).select(column, recency(order).alias("rank"))
    newer = F.avg(F.when(F.col("rank") <= rows, F.col(column)))
    older = F.avg(F.when(F.col("rank") > rows, F.col(column)))
    return ranked.agg(F.when(F.count(F.lit(1)) == 2 * rows, newer - older).otherwise(0.0).alias("trend"))


def recent_share(
    df: DataFrame, rows: int = 100, at_least: float = 60.0, column: str = "wqi", order: Sequence[str] = ORDER
) -> DataFrame:
    """Percent of the newest ``rows`` rows at or above a bound; 0 for a shorter table."""
    newest = last_n(df.select(*order, column), rows, order)
    passing = F.count(F.when(F.col(column) >= at_least, 1))
    share = F.when(F.count(F.lit(1)) == rows, passing / rows * 100).otherwise(0.0)
    return newest.agg(share.alias("recent_pct"))


def every_kth(df: DataFrame, target_rows: int = 500, order: Sequence[str] = ORDER) -> DataFrame:
    """Systematic sample: rows 0, k, 2k, … by ``order`` with k = rows // target (runs a count)."""
    k = max(1, df.count() // target_rows)
    return with_position(df, order).where(F.col("position") % k == 0)


def chrono_split(
    df: DataFrame, test: float = 0.2, order: Sequence[str] = ORDER
) -> tuple[DataFrame, DataFrame]:
    """Oldest rows for training, the newest ``ceil(n · test)`` for testing (runs a rank search)."""
    import math

    n = df.count()
    early = first_rows(df, n - math.ceil(n * test), order)
    return df.where(early), df.where(~early)


def halves_label(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Each row tagged with the half of the series it belongs to."""
    return df.withColumn("half", F.when(first_rows(df, df.count() // 2, order), "first").otherwise("second"))
