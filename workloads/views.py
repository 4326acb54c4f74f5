"""The driver tables seen as sensor readings and weather.

Every view keeps all rows of its table. The same expressions build the Spark
DataFrame and the SQL view, so both sides start from equal data.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from envspark.plans.enrich import wqi

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

# Two empty days are opened after the 10th, so that daily series have a gap.
READINGS = (
    "CASE WHEN day(ts) >= 11 THEN ts + INTERVAL 2 DAYS ELSE ts END AS timestamp",
    "event_id AS record_number",
    "concat('S', CAST(user_id % 5 AS STRING)) AS site",
    f"CASE WHEN event_id % 29 = 0 THEN NULL ELSE 6e0 + {K} * 3e-2 END AS ph",
    "CASE WHEN event_id % 15 = 0 THEN NULL ELSE value / 2e1 END AS turbidity",
    "CASE WHEN event_id % 23 = 0 THEN NULL ELSE 2e2 + value * 4e0 END AS conductance",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 4e0 + (event_id % 97) * 8e-2 END AS do_mgl",
    "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 1.5e1 + hour(ts) * 4e-1 + (event_id % 11) * 1e-1 END AS temperature",
    "CASE WHEN event_id % 8 = 0 THEN NULL ELSE value / 1.5e1 + (event_id % 5) * 1e-1 END AS salinity",
    "CAST(NULL AS DOUBLE) AS chlorophyll",
    "CASE WHEN event_type = 'error' THEN 'Bad' ELSE 'Good' END AS turbidity_quality",
)

READINGS_RAW = (
    "event_id AS record_number",
    "CASE WHEN event_id % 40 = 0 THEN 'Co' ELSE CAST(ts AS STRING) END AS timestamp_text",
    "CASE WHEN event_id % 50 = 0 THEN 'n/a' WHEN event_id % 51 = 0 THEN '' "
    "ELSE concat('1,', lpad(regexp_extract(props, '([0-9]+)', 1), 3, '0')) END AS conductance_text",
    "CASE WHEN event_id % 33 = 0 THEN 'x' ELSE CAST(value AS STRING) END AS turbidity_text",
    "event_type AS quality",
)

# Shifted by ten days: the first readings have no weather, the last weather has no readings.
WEATHER = (
    "CAST(ts + INTERVAL 10 DAYS AS DATE) AS date",
    "value / 1e1 AS rainfall",
    "1.5e1 + (event_id % 13) AS temperature",
    "5e1 + (event_id % 40) AS humidity",
    "(event_id % 9) * 1e0 AS wind_speed",
    "event_type AS weather_condition",
    "event_id AS seq",
)

WEATHER_DISJOINT = (
    "CAST(o_orderdate AS DATE) AS date",
    "o_totalprice / 1e5 AS rainfall",
    "1e1 + (o_custkey % 20) AS temperature",
    "5e1 + (o_orderkey % 50) AS humidity",
    "(o_orderkey % 9) * 1e0 AS wind_speed",
    "CASE WHEN o_orderstatus = 'F' THEN 'Sunny' ELSE 'Rainy' END AS weather_condition",
    "o_orderkey AS seq",
)

READINGS_BIG = (
    "l_shipdate AS timestamp",
    "l_orderkey AS order_id",
    "l_suppkey AS site",
    "6e0 + l_quantity * 6e-2 AS ph",
    "l_discount * 1e2 AS turbidity",
    "l_extendedprice / 5e1 AS conductance",
    "4e0 + l_tax * 1e2 AS do_mgl",
    "l_returnflag AS flag",
)

PARAMS = ("ph", "turbidity", "conductance", "do_mgl", "temperature", "salinity")
BIG_PARAMS = ("ph", "turbidity", "conductance", "do_mgl")

_DEVIATION = {
    "ph": "abs((ph - 7e0) / 1.5e0) * 1e2",
    "turbidity": "abs((turbidity - 0e0) / 5e0) * 1e2",
    "conductance": "abs((conductance - 0e0) / 1.5e3) * 1e2",
    "do_mgl": "abs((do_mgl - 8e0) / (-4e0)) * 1e2",
}
_GAUSSIAN = {
    "ph": "1e2 * exp(-((ph - 7e0) * (ph - 7e0)) / 5e-1)",
    "turbidity": "1e2 * exp(-((turbidity - 1e-1) * (turbidity - 1e-1)) / 8e0)",
    "conductance": "1e2 * exp(-((conductance - 5e2) * (conductance - 5e2)) / 2e4)",
    "do_mgl": "1e2 * exp(-((do_mgl - 8e0) * (do_mgl - 8e0)) / 4.5e0)",
}
_WEIGHTS = {"ph": "2.5e-1", "turbidity": "3.5e-1", "conductance": "2.5e-1", "do_mgl": "1.5e-1"}


def index_sql(source: str, method: str = "deviation") -> str:
    """SQL of the quality index over any table holding its four columns."""
    scores = _DEVIATION if method == "deviation" else _GAUSSIAN
    q = ", ".join(f"{e} AS {c}_q" for c, e in scores.items())
    contrib = ", ".join(f"{c}_q * {w} AS {c}_contrib" for c, w in _WEIGHTS.items())
    total = " + ".join(f"{c}_contrib" for c in _WEIGHTS)
    if method == "deviation":
        score = f"({total}) / ({' + '.join(_WEIGHTS.values())})"
        steps = "WHEN wqi <= 25 THEN 'Excellent' WHEN wqi <= 50 THEN 'Good' WHEN wqi <= 75 THEN 'Poor'"
    else:
        score = f"CASE WHEN {total} < 0 THEN 0 WHEN {total} > 100 THEN 100 ELSE {total} END"
        steps = "WHEN wqi >= 80 THEN 'Excellent' WHEN wqi >= 60 THEN 'Good' WHEN wqi >= 40 THEN 'Poor'"
    return (
        f"SELECT *, CASE WHEN wqi IS NULL THEN 'Unknown' {steps} ELSE 'Very Poor' END AS wqi_class FROM ("
        f"SELECT *, {score} AS wqi FROM (SELECT *, {contrib} FROM (SELECT *, {q} FROM {source}) s1) s2) s3"
    )


def _select(expressions, table):
    return f"SELECT {', '.join(expressions)} FROM {table}"


def weather_daily_sql(source: str) -> str:
    return (
        "SELECT date, sum(rainfall) AS rainfall, avg(temperature) AS rain_temperature, avg(humidity) AS rain_humidity, "
        "avg(wind_speed) AS rain_wind_speed, arg_min(weather_condition, seq) AS rain_weather_condition "
        f"FROM {source} WHERE date IS NOT NULL GROUP BY date"
    )


# In dependency order.
SQL_VIEWS = {
    "readings": _select(READINGS, "events"),
    "readings_raw": _select(READINGS_RAW, "events"),
    "weather": _select(WEATHER, "events"),
    "weather_disjoint": _select(WEATHER_DISJOINT, "orders"),
    "readings_big": _select(READINGS_BIG, "lineitem"),
    "scored": index_sql("readings"),
    "scored_big": index_sql("readings_big"),
    "weather_days": weather_daily_sql("weather"),
    "joined": "SELECT r.*, w.* EXCLUDE (date), CAST(r.timestamp AS DATE) AS date "
    "FROM readings r LEFT JOIN weather_days w ON CAST(r.timestamp AS DATE) = w.date",
    "joined_scored": index_sql("joined"),
    "daily_bounds": "SELECT min(CAST(timestamp AS DATE)) AS d0, max(CAST(timestamp AS DATE)) AS d1 FROM readings",
    "spine": "SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day FROM daily_bounds",
}


def with_views(sql: str) -> str:
    """Prepend the views that a statement names, directly or through another view."""
    needed: set[str] = set()
    text = sql
    for name, body in reversed(SQL_VIEWS.items()):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += " " + body
    ctes = ", ".join(f"{n} AS ({b})" for n, b in SQL_VIEWS.items() if n in needed)
    sql = sql.strip()
    if not ctes:
        return sql
    return f"WITH {ctes}{', ' + sql[5:] if sql.upper().startswith('WITH ') else ' ' + sql}"


class Tables:
    """Lazily built views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        return self.table("events").selectExpr(*READINGS)

    @cached_property
    def readings_raw(self) -> DataFrame:
        return self.table("events").selectExpr(*READINGS_RAW)

    @cached_property
    def weather(self) -> DataFrame:
        return self.table("events").selectExpr(*WEATHER)

    @cached_property
    def weather_disjoint(self) -> DataFrame:
        return self.table("orders").selectExpr(*WEATHER_DISJOINT)

    @cached_property
    def readings_big(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*READINGS_BIG)

    @cached_property
    def scored(self) -> DataFrame:
        return wqi(self.readings)

    @cached_property
    def scored_big(self) -> DataFrame:
        return wqi(self.readings_big)
