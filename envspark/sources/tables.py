"""Reading and writing sensor and weather tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .catalog import first_column_as_date, normalise_headers, timestamp_column


def _read_text_table(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        # Without inferSchema every cell stays text, so bad cells can become NULL later.
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def parse_time(df: DataFrame, column: str, to: str = "timestamp_ntz", name: str | None = None) -> DataFrame:
    """Text to time; what does not parse becomes NULL."""
    parsed = F.col(f"`{column}`").cast("string").try_cast(to)
    return df.withColumn(name or column, parsed)


def read_readings(
    spark: SparkSession, path: str, fmt: str = "csv", schema: StructType | str | None = None
) -> DataFrame:
    """Sensor readings with canonical names and a parsed ``timestamp``."""
    raw = normalise_headers(_read_text_table(spark, path, fmt, schema))
    column = timestamp_column(raw)
    return raw if column is None else parse_time(raw, column, name="timestamp")


def read_weather(
    spark: SparkSession, path: str, fmt: str = "csv", schema: StructType | str | None = None
) -> DataFrame:
    """Daily weather with canonical names and a parsed ``date``."""
    raw = first_column_as_date(normalise_headers(_read_text_table(spark, path, fmt, schema)))
    return parse_time(raw, "date", "date")


def drop_missing_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def write_processed(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    date_format: str = "yyyy-MM-dd HH:mm:ss",
    by_day: str | None = None,
) -> None:
    """Write a table (an action). CSV formats every timestamp; ``by_day`` names a date column to partition by."""
    if fmt == "csv":
        times = [n for n, t in df.dtypes if t in ("timestamp", "timestamp_ntz")]
        df = df.withColumns({c: F.date_format(c, date_format) for c in times})
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    if by_day:
        writer = writer.partitionBy(by_day)
    writer.format(fmt).save(path)


def export_views(df: DataFrame, filtered: DataFrame, statistics: DataFrame, folder: str) -> dict[str, str]:
    """Write the full table, the filtered table and the statistics as CSV (three actions)."""
    paths = {}
    for name, part in (("full", df), ("filtered", filtered), ("statistics", statistics)):
        paths[name] = f"{folder}/{name}"
        write_processed(part, paths[name], "csv")
    return paths
