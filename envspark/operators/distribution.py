"""Histograms, densities and box plots."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.numeric import count_if
from .quantiles import exact_quantiles
from .scale import one_row, report_rows


def box_stats(
    df: DataFrame, column: str, groups: Mapping[str, Column] | None = None, key: str = "grp", whisker: float = 1.5
) -> DataFrame:
    """Five-number summary, whiskers, mean and outlier count, for all rows or per group.

    ``groups`` maps a label to the predicate of its rows. All groups share the
    passes of one quantile search and one aggregate.
    """
    groups = groups or {"all": F.lit(True)}
    return _boxes(df, {(g,): F.when(p, F.col(column)) for g, p in groups.items()}, (key,), whisker)


def _boxes(df: DataFrame, members: Mapping[tuple, Column], keys: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """One box summary per member, its label parts as columns ``keys``; one quantile search for all."""
    quartiles = exact_quantiles(df, members, (0.25, 0.5, 0.75))
    structs = []
    for label, member in members.items():
        q1, q2, q3 = (F.lit(q).cast("double") for q in quartiles[label])
        reach = (q3 - q1) * whisker
        inside = (member >= q1 - reach) & (member <= q3 + reach)
        structs.append(
            F.struct(
                *[F.lit(part).alias(k) for part, k in zip(label, keys)],
                F.count(member).alias("n"),
                F.min(member).alias("min"),
                q1.alias("q1"),
                q2.alias("median"),
                q3.alias("q3"),
                F.max(member).alias("max"),
                F.avg(member).alias("mean"),
                F.min(F.when(inside, member)).alias("whisker_low"),
                F.max(F.when(inside, member)).alias("whisker_high"),
                count_if(~inside).alias("outliers"),
            )
        )
    return report_rows(df, structs).where("n > 0")


def equal_bins(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of a value; the highest value falls in the last bin, a constant column in bin 0."""
    width = (high - low) / bins
    return F.when(
        value.isNotNull(),
        F.when(width > 0, F.least(F.floor((value - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0),
    ).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between minimum and maximum; empty bins count 0."""
    edges = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    counted = (
        df.where(F.col(column).isNotNull())
        .withColumn("_e", one_row(edges))
        .groupBy(equal_bins(F.col(column), F.col("_e.lo"), F.col("_e.hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    return (
        spine.join(F.broadcast(counted), "bin", "left")
        .withColumn("_e", one_row(edges))
        .select(
            "bin",
            (F.col("_e.lo") + width * F.col("bin")).alias("left_edge"),
            (F.col("_e.lo") + width * (F.col("bin") + 1)).alias("right_edge"),
            F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        )
    )


def _bandwidth_row(df: DataFrame, column: str, grid: int) -> DataFrame:
    n = F.count(column)
    return df.agg(
        F.min(column).alias("lo"),
        ((F.max(column) - F.min(column)) / (grid - 1)).alias("step"),
        (F.stddev_samp(column) * F.pow(n, F.lit(-0.2))).alias("h"),
        n.alias("n"),
    )


def kde(df: DataFrame, column: str, grid: int = 200, binned: bool = False, bins: int = 4096) -> DataFrame:
    """Gaussian density on ``grid`` points from minimum to maximum, Scott bandwidth.

    Each task adds up the kernels of its own rows and sends one number per grid
    point. ``binned=True`` first counts values into ``bins``
    equal bins, which makes the cost per row independent of the grid at a small
    loss of accuracy.
    """
    scale = one_row(_bandwidth_row(df, column, grid))
    data = df.where(F.col(column).isNotNull())
    if binned:
        edges = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        width = (F.col("_e.hi") - F.col("_e.lo")) / bins
        bin_ = equal_bins(F.col(column), F.col("_e.lo"), F.col("_e.hi"), bins)
        data = (
            data.withColumn("_e", one_row(edges))
            .groupBy((F.col("_e.lo") + (bin_ + 0.5) * width).alias("_x"))
            .agg(F.count(F.lit(1)).cast("double").alias("_w"))
        )
    else:
        data = data.select(F.col(column).alias("_x"), F.lit(1.0).alias("_w"))
    # A constant column has no bandwidth and so no density.
    density = _densities(data.withColumn("_g", F.lit("")).withColumn("_s", scale).where(F.col("_s.h") > 0), grid)
    return density.drop("_g")


def _densities(data: DataFrame, grid: int) -> DataFrame:
    """Density per group ``_g`` from values ``_x``, weights ``_w`` and the group's scale struct ``_s``.

    There are few groups; each task keeps one array of grid points per group.
    """
    # Distance from the first grid point and grid step, in bandwidths.
    points = data.select(
        "_g",
        ((F.col("_x") - F.col("_s.lo")) / F.col("_s.h")).alias("u"),
        (F.col("_s.step") / F.col("_s.h")).alias("step"),
        F.col("_w").alias("w"),
    )

    def heights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = np.arange(grid)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for group, rows in batch.groupby("_g"):
                total = totals.setdefault(group, np.zeros(grid))
                u, weights, step = rows["u"].to_numpy(), rows["w"].to_numpy(), rows["step"].iloc[0]
                for at in places:
                    z = u - at * step
                    total[at] += weights @ np.exp(-0.5 * z * z)
        for group, total in totals.items():
            yield pd.DataFrame({"_g": group, "point": places, "height": total})

    scales = data.groupBy("_g").agg(F.any_value("_s").alias("_s"))
    sums = (
        points.select("_g", "u", "step", "w")
        .mapInPandas(heights, "_g string, point int, height double")
        .groupBy("_g", "point")
        .agg(F.sum("height").alias("_sum"))
    )
    return sums.join(F.broadcast(scales), "_g").select(
        "_g",
        "point",
        (F.col("_s.lo") + F.col("_s.step") * F.col("point")).alias("x"),
        (F.col("_sum") / (F.col("_s.n") * F.col("_s.h") * math.sqrt(2 * math.pi))).alias("density"),
    )


def recent_months(df: DataFrame, months: int = 4, timestamp: str = "timestamp") -> list[str]:
    """The newest calendar months present, oldest first (runs one small aggregate)."""
    periods = df.where(F.col(timestamp).isNotNull()).groupBy(F.trunc(timestamp, "month").alias("m")).count()
    newest = periods.orderBy(F.col("m").desc()).limit(months)
    return sorted(r["m"].strftime("%Y-%m") for r in newest.collect())


def ridge_distribution(
    df: DataFrame, columns: Sequence[str], months: int = 4, min_values: int = 6, timestamp: str = "timestamp"
) -> DataFrame:
    """Box summary of each parameter in each of the newest months that has enough values."""
    period = cal.month_period(F.col(timestamp))
    labels = recent_months(df, months, timestamp)
    if not labels:
        return box_stats(df.where(F.lit(False)), columns[0], key="month").withColumn("parameter", F.lit(""))
    members = {(m, c): F.when(period == m, F.col(c)) for c in columns for m in labels}
    rows = _boxes(df, members, ("month", "parameter")).where(F.col("n") >= min_values)
    return rows.select(*[c for c in rows.columns if c != "parameter"], "parameter")


def ridge_density(
    df: DataFrame,
    columns: Sequence[str],
    months: int = 4,
    min_values: int = 6,
    grid: int = 200,
    timestamp: str = "timestamp",
) -> DataFrame:
    """Density of each parameter in each of the newest months that has enough values."""
    labels = recent_months(df, months, timestamp)
    month = cal.month_period(F.col(timestamp))
    long = (
        df.select(month.alias("month"), *columns)
        .where(F.col("month").isin(labels))
        .unpivot("month", list(columns), "parameter", "_x")
        .where("_x IS NOT NULL")
        .withColumn("_g", F.concat_ws("|", "parameter", "month"))
    )
    # At most len(columns) * months rows.
    scales = (
        long.groupBy("_g")
        .agg(
            F.min("_x").alias("lo"),
            ((F.max("_x") - F.min("_x")) / (grid - 1)).alias("step"),
            (F.stddev_samp("_x") * F.pow(F.count("_x"), F.lit(-0.2))).alias("h"),
            F.count("_x").alias("n"),
        )
        .where((F.col("n") >= min_values) & (F.col("h") > 0))
        .select("_g", F.struct("lo", "step", "h", "n").alias("_s"))
    )
    data = long.join(F.broadcast(scales), "_g").withColumn("_w", F.lit(1.0))
    parts = F.split("_g", "[|]")
    return _densities(data, grid).select(
        parts[0].alias("parameter"), parts[1].alias("month"), "point", "x", "density"
    )


def density_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Counts on an equal-width grid over all complete pairs; empty cells are left out."""
    pairs = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = one_row(
        pairs.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    )
    binned = pairs.withColumn("_e", edges).select(
        equal_bins(F.col(x), F.col("_e.x0"), F.col("_e.x1"), bins).alias("x_bin"),
        equal_bins(F.col(y), F.col("_e.y0"), F.col("_e.y1"), bins).alias("y_bin"),
    )
    return binned.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("rows"))
