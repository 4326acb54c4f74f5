"""Top rows, samples and ranked reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..defaults import ORDER
from .aggregate import daily_mean
from .scale import last_n, least_tickets, recency, report_rows
from .series import latest_per_site


def top_sites(df: DataFrame, site: str, n: int = 6, column: str = "wqi", order: Sequence[str] = ORDER) -> DataFrame:
    """Sites by their newest index, highest first."""
    newest = latest_per_site(df.select(site, *order, column), site, order)
    return newest.orderBy(F.col(column).desc_nulls_last(), site).limit(n)


def top_days(df: DataFrame, n: int = 6, column: str = "wqi") -> DataFrame:
    """Days by mean index, highest first."""
    return daily_mean(df, [column]).orderBy(F.col(column).desc_nulls_last(), "day").limit(n)


def random_sample(df: DataFrame, n: int = 1000, key: str = "record_number", salt: str = "") -> DataFrame:
    """``n`` rows picked by a hash of their key: the same rows however the table is partitioned."""
    ticket = F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)))
    return least_tickets(df, n, ticket, F.conv(F.substring(ticket, 1, 8), 16, 10).cast("bigint"), key)


def hash_share(key: str = "record_number", salt: str = "") -> Column:
    """Number in 0..999999 from a hash of the row key."""
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % 1_000_000


def random_split(
    df: DataFrame, test: float = 0.2, key: str = "record_number", salt: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key; stable when tasks are retried."""
    in_test = hash_share(key, salt) < int(test * 1_000_000)
    return df.where(~in_test), df.where(in_test)


def rank_columns(df: DataFrame, columns: Sequence[str], n: int = 12) -> DataFrame:
    """Columns by non-null count, then variance (0 with fewer than two values)."""
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("non_null"),
            F.coalesce(F.var_samp(c), F.lit(0.0)).alias("variance"),
        )
        for c in columns
    ]
    report = report_rows(df, structs)
    return report.orderBy(F.desc("non_null"), F.desc("variance"), "column").limit(n)


def multi_series(df: DataFrame, columns: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """Chosen parameters in long form, by time."""
    return df.select(*order, *columns).unpivot(list(order), list(columns), "parameter", "value").orderBy(*order)


def period_rows(df: DataFrame, column: str, rows: int = 30, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest ``rows`` rows and as many before them, tagged by period."""
    ranked = last_n(df.select(*order, column), 2 * rows, order).withColumn("_rank", recency(order))
    period = F.when(F.col("_rank") <= rows, "recent").otherwise("historical")
    return ranked.withColumn("period", period).drop("_rank")


def project(
    df: DataFrame, columns: Sequence[str], limit: int | None = 100, order: Sequence[str] = ORDER
) -> DataFrame:
    """Chosen columns of the first ``limit`` rows by ``order``; every row if ``limit`` is None."""
    if limit is None:
        return df.select(*columns)
    return df.orderBy(*order).limit(limit).select(*columns)
