"""Anomaly flags and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..defaults import ORDER
from ..functions.numeric import count_if, percent, ratio
from .quantiles import exact_quantiles
from .scale import last_n, one_row, report_rows


def iqr_bounds(df: DataFrame, columns: Sequence[str], m: float = 1.5) -> dict[str, tuple[Column, Column]]:
    """Lower and upper fence per column (runs a quantile search over all columns together)."""
    quartiles = exact_quantiles(df, columns, (0.25, 0.75))
    fences = {}
    for c, (q1, q3) in quartiles.items():
        if q1 is None:
            fences[c] = (F.lit(None).cast("double"),) * 2
        else:
            fences[c] = (F.lit(q1 - m * (q3 - q1)), F.lit(q3 + m * (q3 - q1)))
    return fences


def iqr_flag(df: DataFrame, column: str, m: float = 1.5) -> DataFrame:
    """Flags values outside the fences; a missing value is not an anomaly."""
    low, high = iqr_bounds(df, [column], m)[column]
    flag = (F.col(column) < low) | (F.col(column) > high)
    return df.withColumns(
        {"lower_bound": low, "upper_bound": high, "anomaly": F.coalesce(flag, F.lit(False))}
    )


def zscore_flag(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Flags values more than ``threshold`` standard deviations from the mean."""
    stats = one_row(df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")))
    flagged = df.withColumn("_s", stats)
    z = F.abs(ratio(F.col(column) - F.col("_s.mean"), F.col("_s.std")))
    return flagged.withColumns(
        {
            "lower_bound": F.col("_s.mean") - threshold * F.col("_s.std"),
            "upper_bound": F.col("_s.mean") + threshold * F.col("_s.std"),
            "anomaly": F.coalesce(z > threshold, F.lit(False)),
        }
    ).drop("_s")


def outlier_report(df: DataFrame, columns: Sequence[str], m: float = 1.5, of_all_rows: bool = False) -> DataFrame:
    """Outliers per column with their share of known (or of all) rows and the fences, 2 places."""
    structs = []
    for c, (low, high) in iqr_bounds(df, columns, m).items():
        outside = count_if((F.col(c) < low) | (F.col(c) > high))
        whole = F.count(F.lit(1)) if of_all_rows else F.count(c)
        structs.append(
            F.struct(
                F.lit(c).alias("parameter"),
                outside.alias("outliers"),
                F.coalesce(F.bround(percent(outside, whole), 2), F.lit(0.0)).alias("outlier_pct"),
                F.bround(low, 2).alias("lower_bound"),
                F.bround(high, 2).alias("upper_bound"),
            )
        )
    return report_rows(df, structs)


def upper_three_sigma(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> DataFrame:
    """Values above mean + k·std per column; columns without any are left out."""
    limits = one_row(df.agg(*[(F.avg(c) + k * F.stddev_samp(c)).alias(c) for c in columns]))
    over = df.withColumn("_limit", limits)
    report = over.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("parameter"),
                    count_if(F.col(c) > F.col(f"_limit.{c}")).alias("extreme"),
                    F.max(f"_limit.{c}").alias("threshold"),
                )
                for c in columns
            ]
        ).alias("_rows")
    )
    return report.select(F.inline_outer("_rows")).where("extreme > 0")


def anomaly_summary(flagged: DataFrame, column: str) -> DataFrame:
    """Anomalies, their share of all rows, the overall mean and the mean of the anomalies."""
    bad = F.col("anomaly")
    return flagged.agg(
        count_if(bad).alias("anomalies"),
        percent(count_if(bad), F.count(F.lit(1))).alias("anomaly_pct"),
        F.avg(column).alias("mean"),
        F.avg(F.when(bad, F.col(column))).alias("anomaly_mean"),
    )


def normal_rows(flagged: DataFrame) -> DataFrame:
    """Rows that are not anomalies."""
    return flagged.where(~F.col("anomaly"))


def recent_anomalies(
    flagged: DataFrame, columns: Sequence[str], n: int = 10, order: Sequence[str] = ORDER
) -> DataFrame:
    """The newest anomalies."""
    return last_n(flagged.where("anomaly").select(*order, *columns), n, order)


def first_outliers(
    flagged: DataFrame, columns: Sequence[str], n: int = 10, order: Sequence[str] = ORDER
) -> DataFrame:
    """The oldest anomalies."""
    return flagged.where("anomaly").select(*order, *columns).orderBy(*order).limit(n)
