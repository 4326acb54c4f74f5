"""Sketches of every day's values, from which quantiles of any range of days are found in one pass.

A sketch is not exact, but sketches merge: those of a range of days say where
its quantiles must nearly be. The pass over the readings counts what lies below
these brackets and writes what lies inside; the rest of the search sees the
written values only. Counts decide, so sketches that are out of date cost time,
never a wrong result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import day
from ..functions.numeric import bounded
from ..operators.quantiles import EXACT_VALUES, SKETCH_SIZE, SLACK, bracketed_quantiles


class DailySketches:
    """Sketches of ``columns`` at ``path``: one row for each day of each update."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], timestamp: str = "timestamp"):
        self.spark, self.path, self.columns, self.timestamp = spark, path, list(columns), timestamp

    @property
    def _schema(self) -> str:
        return ", ".join(["day date", *[f"sketch_{i} binary" for i in range(len(self.columns))], "update bigint"])

    def _values(self):
        return [bounded(F.col(f"`{c}`").cast("double")) for c in self.columns]

    def update(self, readings: DataFrame, number: int) -> None:
        """Add the sketches of new readings as update ``number``; the same number again replaces them (one job).

        Readings without a timestamp belong to no day and are left out.
        """
        cells = [F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, SKETCH_SIZE)).alias(f"sketch_{i}") for i, v in enumerate(self._values())]
        days = readings.where(F.col(self.timestamp).isNotNull()).groupBy(day(F.col(self.timestamp)).alias("day")).agg(*cells)
        days.write.mode("overwrite").parquet(f"{self.path}/update={int(number)}")

    def days(self, start=None, end=None) -> DataFrame:
        """The stored rows, ``start`` and ``end`` included."""
        try:
            df = self.spark.read.schema(self._schema).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], self._schema)
        return _within(df, F.col("day"), start, end)

    def brackets(self, probabilities: Sequence[float], start=None, end=None) -> list[list[tuple] | None]:
        """For each column a value below and one above each quantile of the range, most likely; ``None`` without sketches.

        Ends of 0 and 1 are open, since a sketch may be older than the least or greatest value.
        """
        ranks = [r for p in probabilities for r in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
        merged = self.days(start, end).agg(*[F.kll_merge_agg_double(f"sketch_{i}").alias(f"m{i}") for i in range(len(self.columns))])
        known = [F.count(f"sketch_{i}").alias(f"n{i}") for i in range(len(self.columns))]
        merged = merged.crossJoin(self.days(start, end).agg(*known))  # one row each
        read = [
            F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"m{i}", F.array(*[F.lit(float(r)) for r in ranks])))
            for i in range(len(self.columns))
        ]
        row = merged.select(*read).first()
        ends = []
        for found in row:
            pairs = None
            if found is not None:
                pairs = [
                    (float("-inf") if ranks[2 * j] == 0.0 else found[2 * j], float("inf") if ranks[2 * j + 1] == 1.0 else found[2 * j + 1])
                    for j in range(len(probabilities))
                ]
            ends.append(pairs)
        return ends

    def quantiles(
        self, readings: DataFrame, probabilities: Sequence[float], start=None, end=None, limit: int = EXACT_VALUES
    ) -> dict[str, list[float | None]]:
        """Exact interpolated quantiles of the readings of a range of days, as :func:`exact_quantiles` gives them (actions).

        ``readings`` are read once if the sketches cover them. Readings without
        a timestamp are in no range of days.
        """
        ts = F.col(self.timestamp)
        rows = readings.where(ts.isNotNull())
        limits = {"start": None if start is None else F.lit(start).cast("date"), "end": None if end is None else F.lit(end).cast("date")}
        kind = dict(readings.dtypes)[self.timestamp]
        if kind in ("timestamp_ntz", "date"):  # the bare column, so that the range reaches the scan
            low, high = limits["start"], limits["end"]
            rows = rows if low is None else rows.where(ts >= low.cast(kind))
            rows = rows if high is None else rows.where(ts < F.date_add(high, 1).cast(kind))
        else:
            rows = _within(rows, day(ts), start, end)
        values = dict(zip(self.columns, self._values()))
        return bracketed_quantiles(rows, values, probabilities, dict(zip(self.columns, self.brackets(probabilities, start, end))), limit)


def _within(df: DataFrame, date, start, end) -> DataFrame:
    df = df if start is None else df.where(date >= F.lit(start).cast("date"))
    return df if end is None else df.where(date <= F.lit(end).cast("date"))
