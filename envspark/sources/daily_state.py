"""Daily statistics that are kept up to date as readings arrive.

A table partitioned by day holds, for each day and site, what can be merged:
values, their sum and their squared deviations. An update reads and writes the
days that the new readings touch and no others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import day
from ..functions.numeric import bounded
from ..operators.aggregate import open_gaps
from ..operators.scale import scratch_path, written


class DailyState:
    """State of ``columns`` at ``path``; ``site`` names a column whose values are kept apart.

    Updates are numbered, and a day remembers the number it was last written
    by: an update that is repeated, after a failure half way say, leaves out the
    days that already have it. Readings may arrive in any order of time.
    Readings without a timestamp are left out; missing, NaN and infinite values
    count as none.
    """

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], timestamp: str = "timestamp", site: str | None = None):
        self.spark, self.path, self.columns, self.timestamp, self.site = spark, path, list(columns), timestamp, site

    @property
    def _schema(self) -> str:
        cells = [f"n_{i} bigint, sum_{i} double, dev_{i} double" for i in range(len(self.columns))]
        return ", ".join(["site string", "rows bigint", "last_update bigint", *cells, "day date"])

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._schema).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self._schema)

    def _parts(self, readings: DataFrame, number: int) -> DataFrame:
        """State of new readings alone: one row a touched day and site, aggregated before the shuffle."""
        values = [bounded(F.col(f"`{c}`").cast("double")) for c in self.columns]
        cells = [F.count(F.lit(1)).alias("rows"), F.lit(number).cast("bigint").alias("last_update")]
        for i, v in enumerate(values):
            n = F.count(v)
            cells += [n.alias(f"n_{i}"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"sum_{i}"), F.coalesce(F.var_pop(v) * n, F.lit(0.0)).alias(f"dev_{i}")]
        site = F.col(f"`{self.site}`").cast("string") if self.site else F.lit("")
        known = readings.where(F.col(self.timestamp).isNotNull())
        return known.groupBy(day(F.col(self.timestamp)).alias("day"), site.alias("site")).agg(*cells)

    def update(self, readings: DataFrame, number: int) -> list:
        """Add ``readings`` as update ``number`` (each update's is greater than those before); the touched days (actions)."""
        parts = written(self._parts(readings, number), "daily_parts")
        touched = [r["day"] for r in parts.select("day").distinct().collect()]  # days, whatever the number of readings
        if not touched:
            return []
        merged = self._merged(self.touched(touched), parts)
        path = scratch_path(self.spark, "daily_merged")
        # Written apart first: the days are replaced while their old files are still there to be read again.
        merged.write.parquet(path)
        rows = self.spark.read.schema(self._schema).parquet(path)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        return sorted(touched)

    def touched(self, days: Sequence) -> DataFrame:
        """The stored rows of some days; only their partitions are read."""
        return self._stored().where(F.col("day").isin([F.lit(d) for d in days]))

    def _merged(self, stored: DataFrame, parts: DataFrame) -> DataFrame:
        s, p = stored.alias("s"), parts.alias("p")
        joined = s.join(p, (F.col("s.day") == F.col("p.day")) & F.col("s.site").eqNullSafe(F.col("p.site")), "full_outer")
        # Rows that this update has already written stay.
        done = F.coalesce(F.col("s.last_update") >= F.col("p.last_update"), F.lit(False))
        old = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0))
        new = lambda c: F.when(done, F.lit(0)).otherwise(F.coalesce(F.col(f"p.{c}"), F.lit(0)))
        cells = [F.when(F.col("p.day").isNull(), F.col("s.site")).otherwise(F.col("p.site")).alias("site"), (old("rows") + new("rows")).alias("rows")]
        cells.append(F.greatest("s.last_update", "p.last_update").alias("last_update"))
        for i in range(len(self.columns)):
            n, m = old(f"n_{i}"), new(f"n_{i}")
            gap = F.when((n > 0) & (m > 0), new(f"sum_{i}") / m - old(f"sum_{i}") / n).otherwise(F.lit(0.0))
            shift = F.when((n > 0) & (m > 0), gap * gap * n * m / (n + m)).otherwise(F.lit(0.0))
            cells += [(n + m).alias(f"n_{i}"), (old(f"sum_{i}") + new(f"sum_{i}")).alias(f"sum_{i}"), (old(f"dev_{i}") + new(f"dev_{i}") + shift).alias(f"dev_{i}")]
        return joined.select(*cells, F.coalesce("s.day", "p.day").alias("day"))

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Keep the state up to date with a stream of readings; batches are numbered by the stream."""

        def one(batch: DataFrame, number: int) -> None:
            self.update(batch, number)

        return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

    def statistics(self, start=None, end=None) -> DataFrame:
        """``day``, the site, ``rows`` and each column's count, mean and standard deviation; ``start`` to ``end`` reads these days only."""
        df = self._stored()
        limits: list[Column] = [F.col("day") >= F.lit(start)] * (start is not None) + [F.col("day") <= F.lit(end)] * (end is not None)
        df = df.where(reduce(lambda a, b: a & b, limits)) if limits else df
        cells = [F.col("site").alias(self.site)] if self.site else []
        for i, c in enumerate(self.columns):
            n = F.col(f"n_{i}")
            cells += [
                n.alias(f"{c}_n"), F.when(n > 0, F.col(f"sum_{i}") / n).alias(c), F.when(n > 1, F.sqrt(F.col(f"dev_{i}") / (n - 1))).alias(f"{c}_std"),
            ]
        return df.select("day", "rows", *cells)

    def means(self) -> DataFrame:
        """Daily means as ``daily_mean`` gives them from all readings: days without readings appear with nulls."""
        sites = [self.site] if self.site else []
        return open_gaps(self.statistics().select("day", *sites, *self.columns), self.columns, sites)
