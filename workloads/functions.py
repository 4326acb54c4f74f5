"""Scalar functions and the quality index."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.functions import calendar as cal
from envspark.functions.numeric import ratio
from envspark.operators.aggregate import class_distribution
from envspark.operators.clean import cap_and_fill
from envspark.plans.enrich import calendar_features as add_calendar, wqi

from .align import _CALENDAR, _CAL_NAMES
from .ingest import _clip_sql
from .registry import query
from .views import BIG_PARAMS, index_sql


@query(f"SELECT record_number, {_CALENDAR} FROM readings")
def calendar_features(t):
    return add_calendar(t.readings).select("record_number", *_CAL_NAMES)


@query(
    "SELECT record_number, CAST(timestamp AS DATE) AS day, strftime(timestamp, '%Y-%m') AS period, "
    "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS text, monthname(timestamp)[1:3] AS month_name, "
    "CAST(date_diff('microsecond', (SELECT min(timestamp) FROM readings), timestamp) // 86400000000 AS BIGINT) AS days_since_first "
    "FROM readings"
)
def date_functions(t):
    first = t.readings.agg(F.min("timestamp")).scalar()
    ts = F.col("timestamp")
    return t.readings.withColumn("_first", first).select(
        "record_number",
        cal.day(ts).alias("day"),
        cal.month_period(ts).alias("period"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("text"),
        cal.month_label(F.month(ts)).alias("month_name"),
        cal.whole_days(F.col("_first"), ts).cast("bigint").alias("days_since_first"),
    )


@query(
    "SELECT record_number, trim(timestamp_text) AS trimmed, lower(quality) AS lowered, replace(conductance_text, ',', '') AS replaced, "
    "starts_with(conductance_text, '1,') AS starts, ends_with(conductance_text, '0') AS ends, contains(timestamp_text, ':') AS has_time, "
    "split_part(conductance_text, ',', 1) AS head FROM readings_raw"
)
def string_functions(t):
    text = F.col("conductance_text")
    return t.readings_raw.select(
        "record_number",
        F.trim("timestamp_text").alias("trimmed"),
        F.lower("quality").alias("lowered"),
        F.regexp_replace(text, ",", "").alias("replaced"),
        F.startswith(text, F.lit("1,")).alias("starts"),
        F.endswith(text, F.lit("0")).alias("ends"),
        F.contains("timestamp_text", F.lit(":")).alias("has_time"),
        F.split_part(text, F.lit(","), F.lit(1)).alias("head"),
    )


@query(
    "SELECT record_number, exp(-turbidity) AS e, pow(ph, 2) AS p, abs(ph - 7) AS a, sqrt(conductance) AS s, "
    "CASE WHEN turbidity < 1 THEN 1 WHEN turbidity > 4 THEN 4 ELSE turbidity END AS clipped, greatest(ph, turbidity) AS hi, "
    "least(ph, turbidity) AS lo, round_even(conductance, 2) AS r, CAST(floor(conductance / 3) AS BIGINT) AS whole FROM readings",
    "e p a s clipped hi lo r",
)
def math_functions(t):
    from envspark.functions.numeric import clip

    turbidity = F.col("turbidity")
    return t.readings.select(
        "record_number",
        F.exp(-turbidity).alias("e"),
        F.pow("ph", F.lit(2)).alias("p"),
        F.abs(F.col("ph") - 7).alias("a"),
        F.sqrt("conductance").alias("s"),
        clip(turbidity, F.lit(1.0), F.lit(4.0)).alias("clipped"),
        F.greatest("ph", "turbidity").alias("hi"),
        F.least("ph", "turbidity").alias("lo"),
        F.bround("conductance", 2).alias("r"),
        F.floor(F.col("conductance") / 3).alias("whole"),
    )


@query(
    "SELECT record_number, ph IS NULL AS ph_missing, turbidity IS NOT NULL AS turbidity_known, coalesce(ph, 7) AS ph_or_ideal, "
    "ph / nullif(turbidity, 0) AS guarded FROM readings",
    "ph_or_ideal guarded",
)
def null_functions(t):
    return t.readings.select(
        "record_number",
        F.isnull("ph").alias("ph_missing"),
        F.isnotnull("turbidity").alias("turbidity_known"),
        F.coalesce("ph", F.lit(7.0)).alias("ph_or_ideal"),
        ratio(F.col("ph"), F.col("turbidity")).alias("guarded"),
    )


_INDEX = [f"{p}_{s}" for p in BIG_PARAMS for s in ("q", "contrib")] + ["wqi"]


@query(f"SELECT record_number, {', '.join(_INDEX)}, wqi_class FROM scored", " ".join(_INDEX))
def wqi_deviation(t):
    return t.scored.select("record_number", *_INDEX, "wqi_class")


@query(
    f"SELECT record_number, {', '.join(_INDEX)}, wqi_class FROM ({index_sql('readings', 'gaussian')}) g", " ".join(_INDEX)
)
def wqi_gaussian(t):
    return wqi(t.readings, "gaussian").select("record_number", *_INDEX, "wqi_class")


@query(
    "SELECT record_number, coalesce(wqi, 0) AS wqi, CASE WHEN wqi >= 80 THEN 'Excellent' WHEN wqi >= 60 THEN 'Good' "
    f"WHEN wqi >= 40 THEN 'Poor' ELSE 'Very Poor' END AS wqi_class FROM ({index_sql('readings', 'gaussian')}) g",
    "wqi",
)
def wqi_gaussian_zero(t):
    return wqi(t.readings, "gaussian", null_policy="zero").select("record_number", "wqi", "wqi_class")


@query(
    "SELECT record_number, (coalesce(ph_contrib, 0) + coalesce(turbidity_contrib, 0) + coalesce(conductance_contrib, 0) + coalesce(do_mgl_contrib, 0)) / "
    "nullif(CASE WHEN ph IS NULL THEN 0 ELSE 0.25 END + CASE WHEN turbidity IS NULL THEN 0 ELSE 0.35 END + "
    "CASE WHEN conductance IS NULL THEN 0 ELSE 0.25 END + CASE WHEN do_mgl IS NULL THEN 0 ELSE 0.15 END, 0) AS wqi FROM scored",
    "wqi",
)
def wqi_renormalised(t):
    return wqi(t.readings, null_policy="renormalise").select("record_number", "wqi")


@query("SELECT wqi_class, flag, count(*) AS rows FROM scored_big GROUP BY 1, 2")
def classify(t):
    return t.scored_big.groupBy("wqi_class", "flag").agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"WITH capped AS (SELECT {', '.join(_clip_sql(c, 'readings') for c in BIG_PARAMS)} FROM readings), "
    f"filled AS (SELECT {', '.join(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM capped)) AS {c}' for c in BIG_PARAMS)} FROM capped), "
    f"idx AS ({index_sql('filled')}) "
    "SELECT d.c AS wqi_class, count(idx.wqi) AS rows, count(idx.wqi) * 1e2 / (SELECT count(*) FROM idx) AS pct "
    "FROM (VALUES ('Excellent'), ('Good'), ('Poor'), ('Very Poor')) d(c) LEFT JOIN idx ON idx.wqi_class = d.c GROUP BY d.c",
    "pct",
)
def cleaned_class_distribution(t):
    cleaned = cap_and_fill(t.readings.select(*BIG_PARAMS), BIG_PARAMS)
    return class_distribution(wqi(cleaned))
