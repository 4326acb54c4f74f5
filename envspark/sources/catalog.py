"""Column discovery from the schema; no job unless stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from ..defaults import NON_NUMERIC_NAMES, SITE_NAMES, TIMESTAMP_NAMES
from ..functions.text import canonical
from ..operators.scale import report_rows


def numeric_columns(
    df: DataFrame,
    exclude: Sequence[str] = ("record_number",),
    without: Sequence[str] = (),
    first: int | None = None,
) -> list[str]:
    """Numeric columns, minus names, minus names holding one of the tokens, at most ``first``."""
    names = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, NumericType)
        and f.name not in exclude
        and not any(token in f.name for token in without)
    ]
    return names[:first]


def text_columns(df: DataFrame) -> list[str]:
    """Text columns that may hold numbers: no dates, record numbers or quality flags."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, StringType)
        and f.name.lower() not in NON_NUMERIC_NAMES
        and not f.name.lower().endswith(("[quality]", "_quality"))
    ]


def site_column(df: DataFrame) -> str | None:
    """First site-like column by the usual names."""
    return next((c for c in SITE_NAMES if c in df.columns), None)


def timestamp_column(df: DataFrame, min_values: int = 6) -> str | None:
    """A column with a usual time name, else the first with enough values that parse (one aggregate)."""
    named = next((c for c in df.columns if c.strip().lower() in TIMESTAMP_NAMES), None)
    if named or not df.columns:
        return named
    parsed = [F.count(F.col(f"`{c}`").cast("string").try_cast("timestamp_ntz")) for c in df.columns]
    counts = df.agg(*[p.alias(f"_{i}") for i, p in enumerate(parsed)]).first()
    return next((c for c, n in zip(df.columns, counts) if n >= min_values), None)


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per type and of their cells that hold a value."""
    kind = lambda f: F.lit(f.dataType.simpleString()).alias("data_type")
    rows = report_rows(df, [F.struct(kind(f), F.count(f"`{f.name}`").alias("filled")) for f in df.schema])
    return rows.groupBy("data_type").agg(F.count(F.lit(1)).alias("columns"), F.sum("filled").alias("filled"))


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trimmed, canonical column names."""
    return df.toDF(*[canonical(c) for c in df.columns])


def first_column_as_date(df: DataFrame) -> DataFrame:
    """The first column becomes ``date`` when no column has that name."""
    return df if "date" in df.columns else df.withColumnRenamed(df.columns[0], "date")


def key_columns(df: DataFrame, limit: int = 8) -> list[str]:
    """Default columns of the data table view."""
    wanted = ("timestamp", "temperature", "do_mgl", "ph", "salinity", "conductance", "turbidity", "chlorophyll")
    return [c for c in wanted if c in df.columns][:limit]
