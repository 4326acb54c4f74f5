"""A table kept in order of time, with a manifest of where its rows are.

Files hold consecutive rows, and the manifest has one row a file: rows before
it, rows in it, least and greatest key. The newest rows, the k-th row or a range
of time are then read from the files that hold them and from no others, and
nothing is sorted again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..defaults import ORDER
from ..operators.scale import bounded_broadcast, order_key

# Rows of a file.
FILE_ROWS = 2_000_000


class OrderedTable:
    """Rows at ``path`` along ``order``, which must be a unique key; rows without a timestamp come first."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str] = ORDER):
        self.spark, self.path, self.order = spark, path, list(order)

    @classmethod
    def write(cls, df: DataFrame, path: str, order: Sequence[str] = ORDER, file_rows: int = FILE_ROWS) -> OrderedTable:
        """Store ``df`` in files of about ``file_rows`` rows (one count, one range shuffle, one scan of the keys).

        The manifest is written last: a table whose writing was broken off has none and can't be opened.
        """
        table = cls(df.sparkSession, path, order)
        keys = [F.col(c).asc_nulls_first() for c in order]
        files = max(1, math.ceil(df.count() / file_rows))
        df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.parquet(f"{path}/rows")
        key = order_key(order)
        # One row a file, so the window without a partition is small.
        before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
        manifest = (
            df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
            .groupBy(F.col("_metadata.file_name").alias("file"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest"))
            .withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        )
        manifest.coalesce(1).write.parquet(f"{path}/manifest")
        return table

    def manifest(self) -> DataFrame:
        """``file``, ``rows``, ``least`` and ``greatest`` key, and ``before``: rows in earlier files."""
        try:
            return self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            raise FileNotFoundError(f"no finished table at {self.path}") from missing

    def rows(self) -> DataFrame:
        """The whole table."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def count(self) -> int:
        """Rows of the table, from the manifest."""
        return self.manifest().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def _opened(self, chosen: DataFrame, name: str, wanted: Column | None = None) -> DataFrame:
        """The rows of some files with their position; names of the chosen files alone come to the driver."""
        files = chosen.select("file", "before").collect()
        if not files:
            return self.rows().where(F.lit(False)).withColumn(name, F.lit(None).cast("bigint"))
        read = self.spark.read.schema(self.rows().schema).parquet(*[f"{self.path}/rows/{f['file']}" for f in files])
        found = self._placed(read, chosen, name)
        return found if wanted is None else found.where(wanted)

    def _cut(self, start: int, end: int) -> DataFrame:
        name = self._unused()
        return self.slice(start, end, name).drop(name)

    def _unused(self) -> str:
        """A name for positions that no column of the table has."""
        return "_" + max(self.rows().columns, key=len)

    def _placed(self, read: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
        if name in read.columns:
            raise ValueError(f"the table has a column {name}; choose another name for positions")
        # The columns are packed, so that names of the table's own can't clash with these.
        packed = read.select(F.struct(*[F.col(f"`{c}`") for c in read.columns]).alias("row"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
        joined = packed.join(bounded_broadcast(manifest.select("file", "before")), "file")
        return joined.select("row.*", (F.col("before") + F.col("place")).alias(name))

    def positions(self, name: str = "position") -> DataFrame:
        """Every row with its place along the order, from 0."""
        return self._placed(self.rows(), self.manifest(), name)

    def slice(self, start: int, end: int, name: str = "position") -> DataFrame:
        """Rows at positions ``start`` to ``end - 1``; opens the files these lie in."""
        chosen = self.manifest().where((F.col("before") < end) & (F.col("before") + F.col("rows") > start))
        return self._opened(chosen, name, (F.col(name) >= start) & (F.col(name) < end))

    def newest(self, n: int) -> DataFrame:
        """The last ``n`` rows."""
        total = self.count()
        return self._cut(max(0, total - n), total)

    def first(self, n: int) -> DataFrame:
        """The first ``n`` rows."""
        return self._cut(0, n)

    def kth(self, k: int) -> DataFrame:
        """The row at position ``k``: one row, or none beyond the end."""
        return self._cut(k, k + 1)

    def every_kth(self, target_rows: int = 500, name: str = "position") -> DataFrame:
        """Rows 0, k, 2k, … with k = rows // target; opens the files that hold one of these."""
        k = max(1, self.count() // target_rows)
        # The first multiple of k at or after the file's start must lie in the file.
        first = F.ceil(F.col("before") / k) * k
        return self._opened(self.manifest().where(first < F.col("before") + F.col("rows")), name, F.col(name) % k == 0)

    def between(self, low, high) -> DataFrame:
        """Rows with ``low <= timestamp < high``; files that lie outside of it stay closed."""
        ts, name = self.order[0], self._unused()
        chosen = self.manifest().where((F.col(f"greatest.{ts}") >= F.lit(low)) & (F.col(f"least.{ts}") < F.lit(high)))
        return self._opened(chosen, name, (F.col(ts) >= F.lit(low)) & (F.col(ts) < F.lit(high))).drop(name)

    def before(self, k: int) -> Column:
        """Predicate true for the first ``k`` rows, made from the key at the boundary; never NULL (opens one file)."""
        if k <= 0:
            return F.lit(False)
        edge = self.kth(k).select(*self.order).first()
        if edge is None:
            return F.lit(True)
        # Lexicographic, nulls first: smaller in one column and equal in all before it.
        smaller, equal = [], []
        for c in self.order:
            column = F.col(c)
            if edge[c] is not None:
                smaller.append(reduce(lambda a, b: a & b, [*equal, column.isNull() | (column < F.lit(edge[c]))]))
            equal.append(column.eqNullSafe(F.lit(edge[c])))
        return F.coalesce(reduce(lambda a, b: a | b, smaller, F.lit(False)), F.lit(False))

    def chrono_split(self, test: float = 0.2) -> tuple[DataFrame, DataFrame]:
        """Oldest rows for training, the newest ``ceil(n · test)`` for testing."""
        total = self.count()
        early = self.before(total - math.ceil(total * test))
        return self.rows().where(early), self.rows().where(~early)
