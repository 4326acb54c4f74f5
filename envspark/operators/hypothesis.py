"""One-way analysis of variance and the two-sample t-test."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..defaults import ORDER
from ..functions.numeric import ratio
from .aggregate import group_moments
from .topk import period_rows


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    # Modified Lentz evaluation; the tiny value stands in for an exact zero.
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(0, 1000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def with_p_value(result: DataFrame, shape_a: Column, shape_b: Column, x: Column, alpha: float = 0.05) -> DataFrame:
    """Adds ``p_value`` and ``significant`` to a one-row test result."""
    beta = F.udf(lambda a, b, x: None if None in (a, b, x) else incomplete_beta(a, b, x), "double")
    return result.withColumn("p_value", beta(shape_a, shape_b, x)).withColumn(
        "significant", F.col("p_value") < alpha
    )


def anova(df: DataFrame, column: str, by: str = "wqi_class", p_value: bool = True) -> DataFrame:
    """F statistic of a column over the groups; no row with fewer than two groups.

    Only counts, means and variances per group leave the first aggregate.
    """
    groups = group_moments(df, column, by)
    total = F.sum("n")
    grand = F.sum(F.col("n") * F.col("mean")) / total
    # Between-group sum from group sums: Σ n·m² − (Σ n·m)² / N.
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * grand * grand
    within = F.sum((F.col("n") - 1) * F.coalesce("variance", F.lit(0.0)))
    k = F.count(F.lit(1))
    result = groups.agg(
        k.alias("groups"),
        total.alias("n"),
        (k - 1).alias("df_between"),
        (total - k).alias("df_within"),
        ratio(ratio(between, k - 1), ratio(within, total - k)).alias("f_statistic"),
    ).where("groups >= 2")
    if not p_value:
        return result
    d1, d2, f = (F.col(c).cast("double") for c in ("df_between", "df_within", "f_statistic"))
    return with_p_value(result, d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_test(
    df: DataFrame, column: str, rows: int = 30, order: Sequence[str] = ORDER, p_value: bool = True
) -> DataFrame:
    """Newest ``rows`` rows against the ``rows`` before (pooled variance); no row for a shorter table."""
    tagged = period_rows(df, column, rows, order)
    recent = F.when(F.col("period") == "recent", F.col(column))
    earlier = F.when(F.col("period") == "historical", F.col(column))
    n1, n2 = F.count(recent), F.count(earlier)
    pooled = ratio((n1 - 1) * F.var_samp(recent) + (n2 - 1) * F.var_samp(earlier), n1 + n2 - 2)
    result = (
        tagged.agg(
            F.count(F.lit(1)).alias("_rows"),
            n1.alias("n_recent"),
            n2.alias("n_historical"),
            F.avg(recent).alias("mean_recent"),
            F.avg(earlier).alias("mean_historical"),
            ratio(
                F.avg(recent) - F.avg(earlier), F.sqrt(pooled * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2)))
            ).alias("t_statistic"),
        )
        .where(F.col("_rows") == 2 * rows)
        .drop("_rows")
    )
    if not p_value:
        return result
    freedom = (F.col("n_recent") + F.col("n_historical") - 2).cast("double")
    t = F.col("t_statistic")
    return with_p_value(result, freedom / 2, F.lit(0.5), freedom / (freedom + t * t))
