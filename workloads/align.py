"""Joining readings and weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.operators import align as ops
from envspark.operators.aggregate import daily_mean
from envspark.operators.anomaly import normal_rows, zscore_flag
from envspark.plans.enrich import enrich as enrich_plan, process_readings, process_weather

from .registry import query
from .views import PARAMS, index_sql

RAIN = "rainfall rain_temperature rain_humidity rain_wind_speed"


def _joined(t):
    return ops.join_daily(t.readings, ops.prefix_weather(ops.weather_daily(t.weather)))


@query(
    "SELECT record_number, date, ph, rainfall, rain_temperature, rain_humidity, rain_wind_speed, rain_weather_condition FROM joined",
    "ph " + RAIN,
)
def left_date_join(t):
    return _joined(t).select(
        "record_number", "date", "ph", *RAIN.split(), "rain_weather_condition"
    )


@query(
    "SELECT record_number, date, ph, rainfall, rain_temperature, rain_humidity, rain_wind_speed, rain_weather_condition FROM joined",
    "ph " + RAIN,
)
def left_date_join_spread(t):
    """The same join with a daily side that counts as too long to broadcast."""
    daily = ops.prefix_weather(ops.weather_daily(t.weather))
    return ops.join_daily(t.readings, daily, max_days=1).select("record_number", "date", "ph", *RAIN.split(), "rain_weather_condition")


def _overlap_sql(weather: str) -> str:
    return (
        "SELECT a_min, a_max, b_min, b_max, (b_max < a_min OR b_min > a_max) AS disjoint FROM "
        "(SELECT min(CAST(timestamp AS DATE)) AS a_min, max(CAST(timestamp AS DATE)) AS a_max FROM readings) a "
        f"CROSS JOIN (SELECT min(date) AS b_min, max(date) AS b_max FROM {weather}) b"
    )


@query(_overlap_sql("weather"))
def overlap_check(t):
    return ops.overlap(t.readings, t.weather)


@query(_overlap_sql("weather_disjoint"))
def overlap_check_disjoint(t):
    return ops.overlap(t.readings, t.weather_disjoint)


_BOUNDS = (
    "WITH b AS (SELECT greatest((SELECT min(CAST(timestamp AS DATE)) FROM readings), (SELECT min(date) FROM weather)) AS lo, "
    "least((SELECT max(CAST(timestamp AS DATE)) FROM readings), (SELECT max(date) FROM weather)) AS hi) "
)


@query(
    _BOUNDS + "SELECT 'readings' AS side, record_number AS id, CAST(timestamp AS DATE) AS date FROM readings, b "
    "WHERE CAST(timestamp AS DATE) BETWEEN lo AND hi UNION ALL "
    "SELECT 'weather', seq, date FROM weather, b WHERE date BETWEEN lo AND hi"
)
def align_ranges(t):
    a, b = ops.align_ranges(t.readings, t.weather)
    left = a.select(F.lit("readings").alias("side"), F.col("record_number").alias("id"), F.to_date("timestamp").alias("date"))
    return left.unionByName(b.select(F.lit("weather").alias("side"), F.col("seq").alias("id"), "date"))


@query("SELECT DISTINCT CAST(timestamp AS DATE) AS date FROM readings INTERSECT SELECT DISTINCT date FROM weather")
def intersect_dates(t):
    return ops.common_dates(t.readings, t.weather)


@query(
    "WITH a AS (SELECT datediff('day', min(CAST(timestamp AS DATE)), max(CAST(timestamp AS DATE))) + 1 AS a_days FROM readings), "
    "b AS (SELECT datediff('day', min(date), max(date)) + 1 AS b_days FROM weather), "
    "c AS (SELECT count(*) AS common_days FROM (SELECT DISTINCT CAST(timestamp AS DATE) AS d FROM readings INTERSECT SELECT DISTINCT date FROM weather) x) "
    "SELECT a_days, b_days, common_days, common_days * 1e2 / least(a_days, b_days) AS coverage_pct FROM a, b, c",
    "coverage_pct",
)
def common_dates(t):
    return ops.date_coverage(t.readings, t.weather)


@query(
    "SELECT record_number, conductance FROM readings WHERE NOT coalesce(abs((conductance - (SELECT avg(conductance) FROM readings)) / "
    "(SELECT stddev_samp(conductance) FROM readings)) > 3, false)",
    "conductance",
)
def anti_normal(t):
    return normal_rows(zscore_flag(t.readings, "conductance")).select("record_number", "conductance")


@query(
    "SELECT d.day_num, d.day_name, count(r.record_number) AS rows FROM (VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),"
    "(4,'Friday'),(5,'Saturday'),(6,'Sunday')) d(day_num, day_name) LEFT JOIN readings r ON isodow(r.timestamp) - 1 = d.day_num GROUP BY 1, 2"
)
def reindex_weekday(t):
    counted = t.readings.groupBy(F.weekday("timestamp").alias("day_num")).agg(F.count(F.lit(1)).alias("rows"))
    return ops.complete_weekdays(counted).withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))


def _enriched_sql() -> str:
    numbers = (*PARAMS, *RAIN.split())
    capped = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END AS {c}"
        for c in numbers
    )
    bounds = ", ".join(f"quantile_cont({c}, 0.001) AS lo_{c}, quantile_cont({c}, 0.999) AS hi_{c}" for c in numbers)
    medians = ", ".join(f"quantile_cont({c}, 0.5) AS md_{c}" for c in numbers)
    filled = ", ".join(f"coalesce({c}, md_{c}) AS {c}" for c in numbers)
    return (
        f"WITH lims AS (SELECT {bounds} FROM joined), "
        f"capped AS (SELECT timestamp, record_number, site, {capped} FROM joined, lims), "
        f"mids AS (SELECT {medians} FROM capped), "
        f"filled AS (SELECT timestamp, record_number, site, {filled} FROM capped, mids), "
        f"indexed AS ({index_sql('filled')}) "
    )


_CALENDAR = (
    "CAST(year(timestamp) AS INTEGER) AS year, CAST(month(timestamp) AS INTEGER) AS month, dayname(timestamp) AS day_of_week, "
    "CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week_num, CAST(isodow(timestamp) >= 6 AS INTEGER) AS is_weekend, "
    "CAST(dayofyear(timestamp) AS INTEGER) AS day_of_year, CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'Winter' "
    "WHEN month(timestamp) IN (3, 4, 5) THEN 'Spring' WHEN month(timestamp) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season, "
    "CAST(hour(timestamp) AS INTEGER) AS hour"
)
_KEEP = [*PARAMS, *RAIN.split(), "ph_contrib", "turbidity_contrib", "conductance_contrib", "do_mgl_contrib", "wqi"]
_CAL_NAMES = ["year", "month", "day_of_week", "day_of_week_num", "is_weekend", "day_of_year", "season", "hour"]


@query(
    _enriched_sql() + f"SELECT record_number, site, {', '.join(_KEEP)}, wqi_class, {_CALENDAR} FROM indexed",
    " ".join(_KEEP),
)
def enrich(t):
    return enrich_plan(t.readings, t.weather).select("record_number", "site", *_KEEP, "wqi_class", *_CAL_NAMES)


_RAW = ("ph", "turbidity", "conductance", "do_mgl")
_RANKS = ", ".join(f"quantile_cont({c}, [1e-3, 5e-1, 9.99e-1]) AS {c}_r" for c in _RAW)
_CAPPED = ", ".join(
    f"CASE WHEN {c} IS NULL THEN {c}_r[2] WHEN {c} < {c}_r[1] THEN {c}_r[1] WHEN {c} > {c}_r[3] THEN {c}_r[3] ELSE {c} END AS {c}" for c in _RAW
)


@query(
    f"WITH timed AS (SELECT * FROM readings WHERE record_number % 41 <> 0), ranks AS (SELECT {_RANKS} FROM timed), "
    f"cleaned AS (SELECT record_number, timestamp, {_CAPPED} FROM timed, ranks) "
    "SELECT record_number, do_mgl AS do_sat, do_mgl_q AS do_sat_q, do_mgl_contrib AS do_sat_contrib, wqi, wqi_class, "
    "CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'Winter' WHEN month(timestamp) IN (3, 4, 5) THEN 'Spring' "
    f"WHEN month(timestamp) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season FROM ({index_sql('cleaned', 'gaussian')}) g",
    "do_sat do_sat_q do_sat_contrib wqi",
)
def readings_processed(t):
    """The batch preset: saturation rated by the gaussian index, rows without a timestamp left out."""
    timed = F.when(F.col("record_number") % 41 != 0, F.col("timestamp")).alias("timestamp")
    rows = t.readings.select(timed, "record_number", "ph", "turbidity", "conductance", F.col("do_mgl").alias("do_sat"))
    return process_readings(rows).select("record_number", "do_sat", "do_sat_q", "do_sat_contrib", "wqi", "wqi_class", "season")


@query(
    _enriched_sql() + "SELECT s.day, avg(wqi) AS wqi, avg(ph) AS ph, avg(turbidity) AS turbidity, avg(rainfall) AS rainfall "
    "FROM spine s LEFT JOIN indexed i ON CAST(i.timestamp AS DATE) = s.day GROUP BY s.day",
    "wqi ph turbidity rainfall",
)
def enrich_daily(t):
    return daily_mean(enrich_plan(t.readings, t.weather), ["wqi", "ph", "turbidity", "rainfall"])


@query(
    "WITH m AS (SELECT month(date) AS month, avg(rainfall) AS mean_r FROM "
    "(SELECT date, sum(rainfall) AS rainfall FROM weather_disjoint GROUP BY date) d GROUP BY 1), "
    "f AS (SELECT r.record_number, r.timestamp, greatest(0, m.mean_r) AS rainfall FROM readings r LEFT JOIN m ON month(r.timestamp) = m.month) "
    "SELECT record_number, rainfall FROM f",
    "rainfall",
)
def enrich_without_overlap(t):
    df = enrich_plan(t.readings, t.weather_disjoint, cap=False, impute_method=None, calendar=False)
    return df.select("record_number", "rainfall")


@query(
    "SELECT seq, date, rainfall, temperature, humidity, wind_speed, weather_condition, CAST(year(date) AS INTEGER) AS year, "
    "CAST(month(date) AS INTEGER) AS month, dayname(date) AS day_of_week, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week_num, "
    "CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(dayofyear(date) AS INTEGER) AS day_of_year, "
    "CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4, 5) THEN 'Spring' "
    "WHEN month(date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season FROM weather_disjoint",
    "rainfall temperature humidity wind_speed",
)
def weather_processed(t):
    return process_weather(t.weather_disjoint)
