"""Query registry: Spark callable and oracle SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 6
# Keeps short decimals that end on the rounding edge (such as means of 32 prices) off it.
NUDGE = 3.3e-8


def _settled(df: DataFrame) -> DataFrame:
    """Doubles to six places, since engines add in different orders; no negative zero."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            r = F.rint((c + NUDGE) * 10.0**PLACES) / 10.0**PLACES
            c = F.when(r == 0, F.lit(0.0)).otherwise(r).alias(name)
        columns.append(c)
    return df.select(*columns)


def _settled_sql(sql: str, doubles: str) -> str:
    if not doubles.split():
        return sql
    unit = f"1e{PLACES}"
    rounded = {c: f"round((CAST({c} AS DOUBLE) + {NUDGE}) * {unit}) / {unit}" for c in doubles.split()}
    cells = ", ".join(f"CASE WHEN {r} = 0 THEN 0e0 ELSE {r} END AS {c}" for c, r in rounded.items())
    return f"SELECT * REPLACE ({cells}) FROM ({sql}) settled"


def query(oracle: str | None = None, doubles: str = "", name: str | None = None):
    """Register a function of :class:`Tables`; ``doubles`` names the oracle's floating-point columns."""

    def register(make: Callable[[Tables], DataFrame]):
        key = name or make.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _settled(make(Tables(spark, sf_dir)))

        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = _settled_sql(with_views(oracle), doubles)
        return make

    return register
