"""Sources, sinks, projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.functions.quality import level
from envspark.operators import clean
from envspark.operators.aggregate import completeness, daily_mean, describe
from envspark.operators.scale import scratch_path
from envspark.operators.topk import project
from envspark.sources import catalog, metrics, tables
from envspark.sources.daily_state import DailyState

from .registry import query
from .views import BIG_PARAMS, PARAMS, READINGS

READING_NAMES = [e.rsplit(" AS ", 1)[1] for e in READINGS]


def _number(text: str) -> str:
    return f"nullif(try_cast({text} AS DOUBLE), CAST('nan' AS DOUBLE))"


# ---------------------------------------------------------------- sources and sinks


@query(
    f"SELECT try_cast(timestamp_text AS TIMESTAMP) AS timestamp, record_number, {_number('turbidity_text')} AS turbidity, "
    "quality FROM readings_raw",
    "turbidity",
)
def read_readings(t):
    path = scratch_path(t.spark, "readings-csv")
    t.readings_raw.select(
        F.col("timestamp_text").alias("Timestamp"),
        F.col("record_number").alias("Record number"),
        F.col("turbidity_text").alias("Turbidity"),
        "quality",
    ).write.option("header", True).csv(path)
    df = tables.read_readings(t.spark, path)
    return clean.coerce_numeric(df).withColumn("record_number", F.col("record_number").cast("bigint"))


@query("SELECT date, rainfall, weather_condition, seq FROM weather", "rainfall")
def read_weather(t):
    path = scratch_path(t.spark, "weather-csv")
    t.weather.select(
        F.col("date").cast("string").alias("Day"), "rainfall", "weather_condition", "seq"
    ).write.option("header", True).csv(path)
    df = tables.read_weather(t.spark, path)
    return clean.coerce_numeric(df, ["rainfall"]).withColumn("seq", F.col("seq").cast("bigint"))


@query(
    "SELECT record_number, do_mgl, conductance, ph FROM readings",
    "do_mgl conductance ph",
)
def normalise_headers(t):
    raw = t.readings.select(
        F.col("record_number").alias(" Record number "),
        F.col("do_mgl").alias("Dissolved Oxygen"),
        F.col("conductance").alias("Specific Conductance "),
        F.col("ph").alias("pH"),
    )
    return catalog.normalise_headers(raw)


@query("SELECT 'timestamp_text' AS found, count(try_cast(timestamp_text AS TIMESTAMP)) AS parsed FROM readings_raw")
def discover_timestamp(t):
    found = catalog.timestamp_column(t.readings_raw.drop("record_number"))
    parsed = tables.parse_time(t.readings_raw, found, name="timestamp")
    return parsed.agg(F.lit(found).alias("found"), F.count("timestamp").alias("parsed"))


@query("SELECT date, count(*) AS rows FROM weather GROUP BY date")
def first_column_as_date(t):
    unnamed = t.weather.withColumnRenamed("date", "day of measurement")
    return catalog.first_column_as_date(unnamed).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, record_number, site, ph, turbidity FROM readings",
    "ph turbidity",
)
def write_processed(t):
    path = scratch_path(t.spark, "processed-csv")
    tables.write_processed(t.readings.select("timestamp", "record_number", "site", "ph", "turbidity"), path, "csv")
    return t.spark.read.schema(
        "timestamp string, record_number bigint, site string, ph double, turbidity double"
    ).option("header", True).csv(path)


@query("SELECT CAST(timestamp AS DATE) AS date, count(*) AS rows, avg(ph) AS ph FROM readings GROUP BY 1", "ph")
def write_by_day(t):
    path = scratch_path(t.spark, "processed-days")
    tables.write_processed(t.readings.withColumn("date", F.col("timestamp").cast("date")), path, by_day="date")
    return t.spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.avg("ph").alias("ph"))


@query(
    "SELECT s.day, avg(ph) AS ph, avg(turbidity) AS turbidity "
    "FROM spine s LEFT JOIN readings r ON CAST(r.timestamp AS DATE) = s.day GROUP BY s.day",
    "ph turbidity",
)
def write_daily(t):
    path = scratch_path(t.spark, "daily-csv")
    tables.write_processed(daily_mean(t.readings, ["ph", "turbidity"]), path, "csv")
    return t.spark.read.schema("day date, ph double, turbidity double").option("header", True).csv(path)


@query(
    "SELECT s.day, avg(ph) AS ph, avg(turbidity) AS turbidity "
    "FROM spine s LEFT JOIN readings r ON CAST(r.timestamp AS DATE) = s.day GROUP BY s.day",
    "ph turbidity",
)
def daily_means_kept(t):
    """Daily means from a state that three updates, none in order of time, have brought up to date."""
    state = DailyState(t.spark, scratch_path(t.spark, "daily-state"), ["ph", "turbidity"])
    for number, rest in enumerate((2, 0, 1)):
        state.update(t.readings.where(F.col("record_number") % 3 == rest), number)
    return state.means()


@query(
    "SELECT CAST(timestamp AS DATE) AS day, site, count(*) AS rows, count(ph) AS ph_n, avg(ph) AS ph, stddev_samp(ph) AS ph_std "
    "FROM readings WHERE day(timestamp) BETWEEN 5 AND 16 GROUP BY 1, 2",
    "ph ph_std",
)
def daily_statistics_kept(t):
    """Counts, means and deviations by day and site; the second update is delivered twice."""
    state = DailyState(t.spark, scratch_path(t.spark, "daily-state"), ["ph"], site="site")
    half = F.col("record_number") % 2 == 0
    state.update(t.readings.where(half), 1)
    for _ in range(2):
        state.update(t.readings.where(~half), 2)
    return state.statistics().where(F.dayofmonth("day").between(5, 16))


@query(
    "SELECT 'full' AS export, count(*) AS rows FROM readings "
    "UNION ALL SELECT 'filtered', count(*) FROM readings WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21' "
    "UNION ALL SELECT 'statistics', 6"
)
def export_views(t):
    filtered = clean.in_date_range(t.readings, "2024-01-05", "2024-01-20")
    paths = tables.export_views(t.readings, filtered, describe(t.readings, PARAMS), scratch_path(t.spark, "exports"))
    parts = [
        t.spark.read.option("header", True).csv(p).agg(F.lit(n).alias("export"), F.count(F.lit(1)).alias("rows"))
        for n, p in paths.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# One metrics record per site: how well the mean of all readings predicts its turbidity.
SITE_METRICS = (
    "SELECT site AS model, 'turbidity' AS target, sqrt(avg(e * e)) AS rmse, 1 - avg(e * e) / var_pop(turbidity) AS r2, "
    "avg(abs(e)) AS mae, count(*) AS train_rows, count(*) AS test_rows FROM ("
    "SELECT site, turbidity, turbidity - (SELECT avg(turbidity) FROM readings) AS e FROM readings) x "
    "WHERE turbidity IS NOT NULL GROUP BY site"
)


def _site_metrics(t):
    mean = t.readings.agg(F.avg("turbidity")).scalar()
    e = F.col("turbidity") - F.col("_m")
    n = F.count(F.lit(1))
    return (
        t.readings.where("turbidity IS NOT NULL")
        .withColumn("_m", mean)
        .groupBy(F.col("site").alias("model"), F.lit("turbidity").alias("target"))
        .agg(
            F.sqrt(F.avg(e * e)).alias("rmse"),
            (1 - F.avg(e * e) / F.var_pop("turbidity")).alias("r2"),
            F.avg(F.abs(e)).alias("mae"),
            n.alias("train_rows"),
            n.alias("test_rows"),
        )
    )


@query(SITE_METRICS, "rmse r2 mae")
def write_metrics(t):
    path = scratch_path(t.spark, "metrics-json")
    metrics.write_metrics(_site_metrics(t), path)
    return t.spark.read.schema(
        "model string, target string, rmse double, r2 double, mae double, train_rows bigint, test_rows bigint"
    ).json(path)


@query(
    f"SELECT lower(model) || '_' || target || '_metrics' AS model, model AS model_type, target, CAST(printf('%.4f', rmse) AS DOUBLE) AS rmse, CAST(printf('%.4f', r2) AS DOUBLE) AS r2, "
    f"CAST(printf('%.4f', mae) AS DOUBLE) AS mae, train_rows, test_rows FROM ({SITE_METRICS}) m",
    "rmse r2 mae",
)
def scan_metrics(t):
    path = scratch_path(t.spark, "metrics-text")
    metrics.write_metrics(_site_metrics(t), path, fmt="text")
    return metrics.scan_metrics(t.spark, path)


# ---------------------------------------------------------------- projections and filters


@query(
    f"SELECT record_number, {_number('conductance_text')} AS conductance_text, {_number('turbidity_text')} AS turbidity_text, "
    "quality, timestamp_text FROM readings_raw",
    "conductance_text turbidity_text",
)
def coerce_numeric(t):
    return clean.coerce_numeric(t.readings_raw, ["conductance_text", "turbidity_text"])


_UNGROUPED = "nullif(replace(conductance_text, ',', ''), '')"


@query(f"SELECT record_number, {_number(_UNGROUPED)} AS conductance FROM readings_raw", "conductance")
def coerce_grouped_numbers(t):
    df = t.readings_raw.select("record_number", F.col("conductance_text").alias("conductance"))
    return clean.coerce_numeric(df, strip_grouping=True)


@query(
    "SELECT 'ph' AS parameter, count(ph) AS filled FROM readings UNION ALL SELECT 'turbidity', count(turbidity) FROM readings "
    "UNION ALL SELECT 'conductance', count(conductance) FROM readings UNION ALL SELECT 'temperature', count(temperature) FROM readings "
    "UNION ALL SELECT 'salinity', count(salinity) FROM readings UNION ALL SELECT 'chlorophyll', 0"
)
def select_numeric(t):
    names = catalog.numeric_columns(t.readings, without=("_",))
    return completeness(t.readings, names).select("parameter", "filled")


@query(
    "SELECT record_number, CAST(timestamp_text AS TIMESTAMP) AS timestamp FROM readings_raw "
    "WHERE try_cast(timestamp_text AS TIMESTAMP) IS NOT NULL"
)
def drop_null_time(t):
    parsed = tables.parse_time(t.readings_raw, "timestamp_text", name="timestamp")
    return tables.drop_missing_time(parsed).select("record_number", "timestamp")


@query(
    "SELECT timestamp, record_number, ph FROM readings WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
    "ph",
)
def date_range_filter(t):
    return clean.in_date_range(t.readings.select("timestamp", "record_number", "ph"), "2024-01-05", "2024-01-20")


@query(
    "SELECT timestamp, record_number, site FROM readings WHERE timestamp >= (SELECT max(timestamp) FROM readings) - INTERVAL 7 DAYS"
)
def last_n_days(t):
    return clean.last_days(t.readings.select("timestamp", "record_number", "site"), 7)


@query(
    "SELECT count(*) FILTER (ph < 6.5 OR ph > 8.5) AS ph_out, "
    "count(*) FILTER (turbidity > (SELECT quantile_cont(turbidity, 0.95) FROM scored)) AS turbidity_high, "
    "count(*) FILTER (wqi >= 60) AS index_ok, count(*) FILTER (do_mgl >= 5) AS do_ok, "
    "count(*) FILTER (turbidity <= 5) AS turbidity_ok, count(*) FILTER (conductance <= 1500) AS conductance_ok FROM scored"
)
def threshold_predicates(t):
    tests = clean.out_of_limits(t.scored)
    return t.scored.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in tests.items()])


@query("SELECT record_number, wqi_class FROM scored WHERE wqi_class IN ('Poor', 'Very Poor')")
def in_predicate(t):
    return t.scored.where(F.col("wqi_class").isin("Poor", "Very Poor")).select("record_number", "wqi_class")


@query("SELECT record_number, ph, do_mgl FROM readings WHERE ph IS NOT NULL AND do_mgl IS NOT NULL", "ph do_mgl")
def dropna_subset(t):
    return t.readings.select("record_number", "ph", "do_mgl").na.drop(subset=["ph", "do_mgl"])


@query(
    "SELECT timestamp, temperature, do_mgl, ph, salinity, conductance, turbidity, chlorophyll FROM readings "
    "ORDER BY readings.timestamp, record_number LIMIT 1000",
    "temperature do_mgl ph salinity conductance turbidity chlorophyll",
)
def project_columns(t):
    return project(t.readings, catalog.key_columns(t.readings), 1000)


@query(
    "SELECT date, rainfall, rain_temperature, rain_humidity, rain_wind_speed, rain_weather_condition FROM weather_days",
    "rainfall rain_temperature rain_humidity rain_wind_speed",
)
def prefix_rename(t):
    from envspark.operators.align import prefix_weather, weather_daily

    return prefix_weather(weather_daily(t.weather))


@query("SELECT site, count(*) AS rows FROM readings GROUP BY site")
def site_column(t):
    return t.readings.groupBy(catalog.site_column(t.readings)).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "SELECT record_number, CASE WHEN ph IS NULL THEN NULL WHEN ph BETWEEN 6.5 AND 8.5 THEN 'Optimal' ELSE 'Off-range' END AS ph_level, "
    "CASE WHEN turbidity IS NULL THEN NULL WHEN turbidity < 5 THEN 'Low' WHEN turbidity < 10 THEN 'Moderate' ELSE 'High' END AS turbidity_level "
    "FROM readings"
)
def label_levels(t):
    ph = F.when(F.col("ph").isNotNull(), F.when(F.col("ph").between(6.5, 8.5), "Optimal").otherwise("Off-range"))
    turbidity = level(F.col("turbidity"), [(5.0, "Low"), (10.0, "Moderate")], "High")
    return t.readings.select("record_number", ph.alias("ph_level"), turbidity.alias("turbidity_level"))


# ---------------------------------------------------------------- cleaning


def _clip_sql(c: str, source: str) -> str:
    low, high = (f"(SELECT quantile_cont({c}, {p}) FROM {source})" for p in (0.001, 0.999))
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < {low} THEN {low} WHEN {c} > {high} THEN {high} ELSE {c} END AS {c}"


@query(
    f"SELECT record_number, {', '.join(_clip_sql(c, 'readings') for c in PARAMS)}, chlorophyll FROM readings",
    " ".join(PARAMS) + " chlorophyll",
)
def cap_outliers(t):
    slim = t.readings.select("record_number", *PARAMS, "chlorophyll")
    return clean.cap_outliers(slim, [*PARAMS, "chlorophyll"])


@query(
    f"SELECT order_id, site, {', '.join(_clip_sql(c, 'readings_big') for c in BIG_PARAMS)} FROM readings_big",
    " ".join(BIG_PARAMS),
)
def cap_outliers_big(t):
    return clean.cap_outliers(t.readings_big.select("order_id", "site", *BIG_PARAMS), BIG_PARAMS)


def _fill_sql(how: str) -> str:
    cells = ", ".join(f"coalesce({c}, (SELECT {how.format(c=c)} FROM readings)) AS {c}" for c in PARAMS)
    return f"SELECT record_number, {cells}, chlorophyll FROM readings"


@query(_fill_sql("quantile_cont({c}, 0.5)"), " ".join(PARAMS) + " chlorophyll")
def impute_median(t):
    return clean.impute(t.readings.select("record_number", *PARAMS, "chlorophyll"), [*PARAMS, "chlorophyll"])


@query(_fill_sql("avg({c})"), " ".join(PARAMS) + " chlorophyll")
def impute_mean(t):
    slim = t.readings.select("record_number", *PARAMS, "chlorophyll")
    return clean.impute(slim, [*PARAMS, "chlorophyll"], "mean")


def _ffill_sql(c: str, by: str = "") -> str:
    w = f"OVER ({by} ORDER BY timestamp, record_number"
    return (
        f"coalesce(last_value({c} IGNORE NULLS) {w} ROWS UNBOUNDED PRECEDING), "
        f"first_value({c} IGNORE NULLS) {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    )


@query(
    f"SELECT record_number, {', '.join(_ffill_sql(c) for c in ('ph', 'turbidity', 'temperature'))} FROM readings",
    "ph turbidity temperature",
)
def impute_ffill_bfill(t):
    slim = t.readings.select("timestamp", "record_number", "ph", "turbidity", "temperature")
    return clean.impute(slim, ["ph", "turbidity", "temperature"], "ffill_bfill").drop("timestamp")


@query(
    f"SELECT record_number, site, {_ffill_sql('ph', 'PARTITION BY site')} FROM readings",
    "ph",
)
def impute_ffill_bfill_by_site(t):
    slim = t.readings.select("timestamp", "record_number", "site", "ph")
    return clean.impute(slim, ["ph"], "ffill_bfill", site="site").drop("timestamp")


@query(
    "WITH newest AS (SELECT record_number, ph, turbidity FROM readings ORDER BY timestamp DESC, record_number DESC LIMIT 2000) "
    "SELECT record_number, coalesce(ph, (SELECT quantile_cont(ph, 0.5) FROM newest)) AS ph, "
    "coalesce(turbidity, (SELECT quantile_cont(turbidity, 0.5) FROM newest)) AS turbidity FROM newest",
    "ph turbidity",
)
def impute_within_subset(t):
    slim = t.readings.select("timestamp", "record_number", "ph", "turbidity")
    return clean.impute_recent(slim, ["ph", "turbidity"], 2000).drop("timestamp")


@query(
    "SELECT record_number, coalesce(ph_contrib, 0) AS ph_contrib, coalesce(do_mgl_contrib, 0) AS do_mgl_contrib FROM scored",
    "ph_contrib do_mgl_contrib",
)
def fill_zero(t):
    slim = t.scored.select("record_number", "ph_contrib", "do_mgl_contrib")
    return clean.impute(slim, ["ph_contrib", "do_mgl_contrib"], "zero")


@query(
    "SELECT 'ph' AS parameter, count(ph) * 1e0 / count(*) AS coverage FROM readings UNION ALL "
    "SELECT 'turbidity', count(turbidity) * 1e0 / count(*) FROM readings UNION ALL "
    "SELECT 'do_mgl', count(do_mgl) * 1e0 / count(*) FROM readings",
    "coverage",
)
def coverage_filter(t):
    kept = clean.covered_columns(t.readings, ["ph", "turbidity", "do_mgl", "chlorophyll"])
    report = completeness(t.readings, kept)
    return report.select("parameter", (F.col("pct") / 100).alias("coverage"))


@query(
    "WITH m AS (SELECT month(date) AS month, avg(rainfall) AS mean_r, stddev_samp(rainfall) AS std_r FROM weather_disjoint GROUP BY 1), "
    "o AS (SELECT avg(rainfall) AS mean_o, stddev_samp(rainfall) AS std_o FROM weather_disjoint) "
    "SELECT s.day AS date, greatest(0, coalesce(mean_r, mean_o)) AS rainfall, "
    "CASE WHEN mean_r IS NULL THEN std_o ELSE coalesce(std_r, greatest(0.1, std_o)) END AS rainfall_std, true AS is_filled "
    "FROM spine s CROSS JOIN o LEFT JOIN m ON month(s.day) = m.month",
    "rainfall rainfall_std",
)
def climatology_fill(t):
    span = t.readings.agg(F.to_date(F.min("timestamp")).alias("a"), F.to_date(F.max("timestamp")).alias("b")).first()
    return clean.climatology_fill(t.weather_disjoint, F.lit(span["a"]), F.lit(span["b"]), ["rainfall"])
