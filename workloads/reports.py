"""Aggregate reports and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.defaults import CLASSES, UNKNOWN_CLASS
from envspark.functions import calendar as cal
from envspark.operators import aggregate as agg, align, distribution as dist
from envspark.operators.scale import scratch_path
from envspark.plans.enrich import wqi
from envspark.sources.catalog import type_counts
from envspark.sources.daily_sketches import DailySketches

from .align import RAIN, _joined
from .registry import query
from .views import BIG_PARAMS, PARAMS

ORDERED = "ORDER BY timestamp DESC, record_number DESC"
RECENT = "recent AS (SELECT * FROM scored WHERE timestamp >= (SELECT max(timestamp) FROM scored) - INTERVAL 7 DAYS)"


def _each(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query(
    f"WITH r AS (SELECT wqi, row_number() OVER ({ORDERED}) AS rn FROM scored) "
    "SELECT count(*) AS records, avg(wqi) AS avg_wqi, avg(ph) AS avg_ph, avg(turbidity) AS avg_turbidity, "
    "count(*) * 1e0 / (date_diff('microsecond', min(timestamp), max(timestamp)) // 86400000000 + 1) AS records_per_day, "
    "(SELECT wqi FROM r WHERE rn = 1) AS current_wqi, CASE WHEN (SELECT wqi FROM r WHERE rn = 7) = 0 THEN 0 ELSE "
    "((SELECT wqi FROM r WHERE rn = 1) - (SELECT wqi FROM r WHERE rn = 7)) * 1e2 / (SELECT wqi FROM r WHERE rn = 7) END AS change_pct FROM scored",
    "avg_wqi avg_ph avg_turbidity records_per_day current_wqi change_pct",
)
def kpis(t):
    return agg.kpis(t.scored)


# The rows of the newest days have no weather yet; their rainfall is unknown and stays out of the average.
@query(
    f"WITH r AS (SELECT wqi, row_number() OVER ({ORDERED}) AS rn FROM joined_scored WHERE wqi IS NOT NULL) "
    "SELECT count(*) AS records, avg(wqi) AS avg_wqi, avg(ph) AS avg_ph, avg(turbidity) AS avg_turbidity, avg(rainfall) AS avg_rainfall, "
    "count(*) * 1e0 / (date_diff('microsecond', min(timestamp), max(timestamp)) // 86400000000 + 1) AS records_per_day, "
    "(SELECT wqi FROM r WHERE rn = 1) AS current_wqi, ((SELECT wqi FROM r WHERE rn = 1) - (SELECT wqi FROM r WHERE rn = 7)) * 1e2 / "
    "nullif((SELECT wqi FROM r WHERE rn = 7), 0) AS change_pct FROM joined_scored WHERE wqi IS NOT NULL",
    "avg_wqi avg_ph avg_turbidity avg_rainfall records_per_day current_wqi change_pct",
)
def kpis_with_rain(t):
    return agg.kpis(wqi(_joined(t)).where("wqi IS NOT NULL"))


@query(
    "SELECT d.c AS wqi_class, count(s.record_number) AS rows, count(s.record_number) * 1e2 / (SELECT count(*) FROM scored) AS pct "
    "FROM (VALUES ('Excellent'), ('Good'), ('Poor'), ('Very Poor'), ('Unknown')) d(c) LEFT JOIN scored s ON s.wqi_class = d.c GROUP BY d.c",
    "pct",
)
def class_distribution(t):
    return agg.class_distribution(t.scored, (*CLASSES, UNKNOWN_CLASS))


@query(
    "SELECT d.c AS wqi_class, count(s.order_id) AS rows, count(s.order_id) * 1e2 / (SELECT count(*) FROM scored_big) AS pct "
    "FROM (VALUES ('Excellent'), ('Good'), ('Poor'), ('Very Poor')) d(c) LEFT JOIN scored_big s ON s.wqi_class = d.c GROUP BY d.c",
    "pct",
)
def class_distribution_big(t):
    return agg.class_distribution(t.scored_big)


_MEANS = ", ".join(f"avg({c}) AS {c}" for c in PARAMS)


@query(
    f"SELECT s.day, {_MEANS} FROM spine s LEFT JOIN readings r ON CAST(r.timestamp AS DATE) = s.day GROUP BY s.day", " ".join(PARAMS)
)
def daily_mean(t):
    return agg.daily_mean(t.readings, PARAMS)


@query(
    "SELECT b.site, b.day, avg(ph) AS ph FROM (SELECT site, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day FROM "
    "(SELECT site, min(CAST(timestamp AS DATE)) AS d0, max(CAST(timestamp AS DATE)) AS d1 FROM readings GROUP BY site) x) b "
    "LEFT JOIN readings r ON r.site = b.site AND CAST(r.timestamp AS DATE) = b.day GROUP BY 1, 2",
    "ph",
)
def daily_mean_by_site(t):
    return agg.daily_mean(t.readings, ["ph"], site="site")


@query(
    "SELECT CAST(timestamp AS DATE) AS day, count(*) AS rows, avg(ph) AS ph, avg(conductance) AS conductance FROM readings_big GROUP BY 1",
    "ph conductance",
)
def daily_volume_big(t):
    return t.readings_big.groupBy(cal.day(F.col("timestamp")).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("ph").alias("ph"), F.avg("conductance").alias("conductance")
    )


@query(
    "SELECT date, rainfall, rain_temperature AS temperature, rain_humidity AS humidity, rain_wind_speed AS wind_speed, "
    "rain_weather_condition AS weather_condition FROM weather_days",
    "rainfall temperature humidity wind_speed",
)
def weather_daily(t):
    return align.weather_daily(t.weather)


@query(
    "SELECT date, sum(rainfall) AS rainfall, sum(temperature) AS temperature, sum(humidity) AS humidity, sum(wind_speed) AS wind_speed, "
    "arg_min(weather_condition, seq) AS weather_condition FROM weather GROUP BY date",
    "rainfall temperature humidity wind_speed",
)
def weather_daily_sums(t):
    return align.weather_daily(t.weather, numeric_agg="sum")


_DESCRIBE = (
    "SELECT '{{c}}' AS parameter, count({{c}}) AS n, avg({{c}}) AS mean, stddev_samp({{c}}) AS std, min({{c}}) AS min, max({{c}}) AS max{extra}, "
    "quantile_cont({{c}}, 0.25) AS q25, quantile_cont({{c}}, 0.5) AS median, quantile_cont({{c}}, 0.75) AS q75 FROM {source}"
)
_D = "mean std min max q25 median q75"


@query(_each((*PARAMS, "chlorophyll"), _DESCRIBE.format(extra="", source="readings")), _D)
def describe(t):
    return agg.describe(t.readings, [*PARAMS, "chlorophyll"])


@query(_each(BIG_PARAMS, _DESCRIBE.format(extra="", source="readings_big")), _D)
def describe_big(t):
    return agg.describe(t.readings_big, BIG_PARAMS)


@query(
    f"SELECT *, std * 1e2 / nullif(mean, 0) AS cv_pct FROM ({_each(PARAMS, _DESCRIBE.format(extra='', source='readings'))}) d", _D + " cv_pct"
)
def cv_table(t):
    return agg.cv_table(t.readings, PARAMS)


@query("SELECT CASE WHEN avg(wqi) = 0 THEN 0 ELSE stddev_samp(wqi) / avg(wqi) * 1e2 END AS variability_pct FROM scored", "variability_pct")
def index_variability(t):
    return agg.index_variability(t.scored)


@query(
    _each(
        PARAMS,
        _DESCRIBE.format(
            extra=", max({c}) - min({c}) AS range, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis", source="readings"
        ).replace("{{c}}", "{c}"),
    ),
    _D + " range skewness kurtosis",
)
def shape_stats(t):
    return agg.shape_stats(t.readings, PARAMS)


_TYPES = {
    "timestamp": "timestamp_ntz",
    "record_number": "bigint",
    "site": "string",
    **{c: "double" for c in (*PARAMS, "chlorophyll")},
    "turbidity_quality": "string",
}
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS data_type, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"round_even((count(*) - count({c})) * 1e2 / count(*), 2) AS null_pct FROM readings"
    for c, k in _TYPES.items()
)


@query(_NULLS, "null_pct")
def null_report(t):
    return agg.null_report(t.readings)


@query(f"SELECT * FROM ({_NULLS}) n WHERE nulls > 0", "null_pct")
def null_report_missing(t):
    return agg.null_report(t.readings, only_missing=True)


_CELLS = " + ".join(f"count({c})" for c in _TYPES)


@query(
    f"SELECT count(*) * {len(_TYPES)} - ({_CELLS}) AS null_cells, (count(*) * {len(_TYPES)} - ({_CELLS})) * 1e2 / (count(*) * {len(_TYPES)}) AS null_pct, "
    f"1 - (count(*) * {len(_TYPES)} - ({_CELLS})) * 1e0 / (count(*) * {len(_TYPES)}) AS completeness FROM readings",
    "null_pct completeness",
)
def null_totals(t):
    return agg.null_totals(t.readings)


@query(
    f"SELECT data_type, count(*) AS columns, CAST(sum(non_null) AS BIGINT) AS filled FROM ({_NULLS}) n GROUP BY 1"
)
def dtype_counts(t):
    return type_counts(t.readings)


@query("SELECT CAST(hour(timestamp) AS INTEGER) AS hour, avg(temperature) AS mean FROM readings GROUP BY 1", "mean")
def hourly_mean(t):
    return agg.hourly_mean(t.readings, "temperature")


_DAYS = "(VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),(4,'Friday'),(5,'Saturday'),(6,'Sunday')) d(day_num, day_name)"


@query(
    f"SELECT d.day_num, d.day_name, avg(turbidity) AS mean FROM {_DAYS} LEFT JOIN readings r ON isodow(r.timestamp) - 1 = d.day_num GROUP BY 1, 2",
    "mean",
)
def weekday_mean(t):
    return agg.weekday_mean(t.readings, "turbidity")


@query(
    "SELECT CAST(month(date) AS INTEGER) AS month, monthname(date)[1:3] AS month_name, avg(rainfall) AS mean, stddev_samp(rainfall) AS std "
    "FROM weather_disjoint GROUP BY 1, 2",
    "mean std",
)
def monthly_mean_std(t):
    return agg.monthly_mean_std(t.weather_disjoint, "rainfall", "date")


_HOURS = [f"h{h:02d}" for h in range(24)]


@query(
    f"SELECT d.day_num, d.day_name, {', '.join(f'avg(CASE WHEN hour(timestamp) = {h} THEN conductance END) AS h{h:02d}' for h in range(24))} "
    f"FROM {_DAYS} LEFT JOIN readings r ON isodow(r.timestamp) - 1 = d.day_num GROUP BY 1, 2",
    " ".join(_HOURS),
)
def weekday_hour_pivot(t):
    return agg.weekday_hour_pivot(t.readings, "conductance")


def _box_sql(column: str, key: str, source: str) -> str:
    return (
        f"WITH q AS (SELECT {key} AS grp, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median, "
        f"quantile_cont({column}, 0.75) AS q3 FROM {source} WHERE {column} IS NOT NULL GROUP BY 1) "
        f"SELECT q.grp, count(*) AS n, min({column}) AS min, q1, median, q3, max({column}) AS max, avg({column}) AS mean, "
        f"min(CASE WHEN {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {column} END) AS whisker_low, "
        f"max(CASE WHEN {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {column} END) AS whisker_high, "
        f"count(*) FILTER ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS outliers "
        f"FROM {source} JOIN q ON q.grp = {key} WHERE {column} IS NOT NULL GROUP BY q.grp, q1, median, q3"
    )


_BOX = "min q1 median q3 max mean whisker_low whisker_high"


@query(_box_sql("turbidity", "dayname(timestamp)", "readings"), _BOX)
def box_stats(t):
    from envspark.defaults import WEEKDAYS

    name = cal.weekday_name(F.col("timestamp"))
    return dist.box_stats(t.readings, "turbidity", {d: name == d for d in WEEKDAYS})


@query(_box_sql("temperature", "wqi_class", "scored"), _BOX)
def box_stats_by_class(t):
    groups = {c: F.col("wqi_class") == c for c in (*CLASSES, UNKNOWN_CLASS)}
    return dist.box_stats(t.scored, "temperature", groups)


@query(_box_sql("conductance", "'all'", "readings_big"), _BOX)
def box_stats_big(t):
    return dist.box_stats(t.readings_big, "conductance")


@query(
    "WITH e AS (SELECT min(conductance) AS lo, max(conductance) AS hi FROM readings), "
    "b AS (SELECT CAST(least(floor((conductance - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin FROM readings, e WHERE conductance IS NOT NULL), "
    "c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) "
    "SELECT CAST(s.i AS INTEGER) AS bin, lo + (hi - lo) / 40 * s.i AS left_edge, lo + (hi - lo) / 40 * (s.i + 1) AS right_edge, coalesce(c.n, 0) AS rows "
    "FROM (SELECT unnest(range(40)) AS i) s CROSS JOIN e LEFT JOIN c ON c.bin = s.i",
    "left_edge right_edge",
)
def histogram(t):
    return dist.histogram(t.readings, "conductance", 40)


@query(
    "WITH s AS (SELECT min(turbidity) AS lo, (max(turbidity) - min(turbidity)) / 199 AS step, stddev_samp(turbidity) * pow(count(turbidity), -0.2) AS h, "
    "count(turbidity) AS n FROM readings), g AS (SELECT unnest(range(200)) AS i) "
    "SELECT CAST(i AS INTEGER) AS point, any_value(lo + step * i) AS x, sum(exp(-0.5 * pow((lo + step * i - turbidity) / h, 2))) / any_value(n * h * sqrt(2 * pi())) AS density "
    "FROM g CROSS JOIN s CROSS JOIN readings WHERE turbidity IS NOT NULL GROUP BY i",
    "x density",
)
def kde(t):
    return dist.kde(t.readings, "turbidity")


@query(
    "WITH s AS (SELECT min(conductance) AS lo, max(conductance) AS hi, (max(conductance) - min(conductance)) / 4096 AS width, "
    "(max(conductance) - min(conductance)) / 199 AS step, stddev_samp(conductance) * pow(count(conductance), -0.2) AS h, count(conductance) AS n FROM readings_big), "
    "b AS (SELECT lo + (least(floor((conductance - lo) / width), 4095) + 5e-1) * width AS x, count(*) AS w "
    "FROM readings_big, s WHERE conductance IS NOT NULL GROUP BY 1), g AS (SELECT unnest(range(200)) AS i) "
    "SELECT CAST(i AS INTEGER) AS point, any_value(lo + step * i) AS x, "
    "sum(w * exp(-0.5 * pow((lo + step * i - b.x) / h, 2))) / any_value(n * h * sqrt(2 * pi())) AS density FROM g CROSS JOIN s CROSS JOIN b GROUP BY i",
    "x density",
)
def kde_binned(t):
    return dist.kde(t.readings_big, "conductance", binned=True)


_RIDGE = " UNION ALL ".join(
    f"SELECT '{c}' AS parameter, b.* RENAME (grp AS month) FROM ("
    + _box_sql(c, "strftime(timestamp, '%Y-%m')", "readings")
    + ") b WHERE n >= 6"
    for c in PARAMS[:4]
)


@query(_RIDGE, _BOX)
def ridge_distribution(t):
    return dist.ridge_distribution(t.readings, PARAMS[:4])


_RIDGE_DENSITY = " UNION ALL ".join(
    f"SELECT '{c}' AS parameter, month, CAST(i AS INTEGER) AS point, any_value(lo + step * i) AS x, "
    f"sum(exp(-0.5 * pow((lo + step * i - {c}) / h, 2))) / any_value(n * h * sqrt(2 * pi())) AS density FROM readings "
    f"JOIN (SELECT strftime(timestamp, '%Y-%m') AS month, min({c}) AS lo, (max({c}) - min({c})) / 199 AS step, "
    f"stddev_samp({c}) * pow(count({c}), -0.2) AS h, count({c}) AS n FROM readings GROUP BY 1 HAVING count({c}) >= 6) s "
    f"ON strftime(readings.timestamp, '%Y-%m') = s.month CROSS JOIN (SELECT unnest(range(200)) AS i) g WHERE {c} IS NOT NULL GROUP BY month, i"
    for c in BIG_PARAMS
)


@query(_RIDGE_DENSITY, "x density")
def ridge_density(t):
    return dist.ridge_density(t.readings, BIG_PARAMS)


@query(
    "WITH p AS (SELECT ph, turbidity FROM readings WHERE ph IS NOT NULL AND turbidity IS NOT NULL), "
    "e AS (SELECT min(ph) AS x0, max(ph) AS x1, min(turbidity) AS y0, max(turbidity) AS y1 FROM p) "
    "SELECT CAST(least(floor((ph - x0) / ((x1 - x0) / 20)), 19) AS INTEGER) AS x_bin, CAST(least(floor((turbidity - y0) / ((y1 - y0) / 20)), 19) AS INTEGER) AS y_bin, "
    "count(*) AS rows FROM p, e GROUP BY 1, 2"
)
def density_2d(t):
    return dist.density_2d(t.readings, "ph", "turbidity")


_COMPLETE = "SELECT parameter, filled, pct, CASE WHEN pct >= 95 THEN 'Excellent' WHEN pct >= 80 THEN 'Good' WHEN pct >= 60 THEN 'Fair' ELSE 'Poor' END AS category FROM (" + _each(
    (*PARAMS, "chlorophyll"), "SELECT '{c}' AS parameter, count({c}) AS filled, count({c}) * 1e2 / count(*) AS pct FROM readings"
) + ") f"


@query(_COMPLETE, "pct")
def completeness(t):
    return agg.completeness(t.readings, [*PARAMS, "chlorophyll"])


@query(
    f"SELECT category, parameter, CAST(sum(filled) AS BIGINT) AS filled, avg(pct) AS pct, CAST(grouping(category, parameter) AS BIGINT) AS level FROM ({_COMPLETE}) c "
    "GROUP BY ROLLUP (category, parameter)",
    "pct",
)
def completeness_rollup(t):
    return agg.completeness_rollup(t.readings, [*PARAMS, "chlorophyll"])


@query(
    "SELECT CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'Winter' WHEN month(timestamp) IN (3, 4, 5) THEN 'Spring' "
    "WHEN month(timestamp) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season, wqi_class, count(*) AS rows FROM scored_big GROUP BY 1, 2"
)
def season_class(t):
    return agg.season_class(t.scored_big)


@query(
    "SELECT count(DISTINCT site) AS sites, count(DISTINCT CASE WHEN timestamp >= (SELECT max(timestamp) FROM readings_big) - INTERVAL 7 DAYS THEN site END) AS active_sites "
    "FROM readings_big"
)
def active_sites(t):
    return agg.active_sites(t.readings_big, "site")


@query(
    "SELECT day, (SELECT count(DISTINCT site) FROM readings r WHERE CAST(r.timestamp AS DATE) <= s.day AND CAST(r.timestamp AS DATE) > s.day - INTERVAL 2 DAYS) AS active_sites "
    "FROM spine s"
)
def active_sites_by_day(t):
    """Distinct sites of each day and the day before; gaps have days without any."""
    return agg.active_sites_by_day(t.readings, "site", days=2)


@query(
    "SELECT date_diff('microsecond', min(timestamp), max(timestamp)) // 86400000000 AS days, count(*) AS records, "
    "count(*) * 1e0 / greatest(date_diff('microsecond', min(timestamp), max(timestamp)) // 86400000000, 1) AS samples_per_day, "
    "min(timestamp) AS first, max(timestamp) AS latest FROM readings",
    "samples_per_day",
)
def coverage_summary(t):
    return agg.coverage_summary(t.readings)


@query(
    "SELECT sum(rainfall) AS total, avg(rainfall) AS mean, max(rainfall) AS max, count(*) FILTER (rainfall > 0) AS wet_days, "
    "count(*) FILTER (rainfall > 0) * 1e2 / count(*) AS wet_pct, datediff('day', min(date), max(date)) + 1 AS span_days FROM weather",
    "total mean max wet_pct",
)
def weather_summary(t):
    return agg.weather_summary(t.weather)


_RAIN_ALL = (*RAIN.split(), "rain_weather_condition")
_SHARES = ", ".join(f"count({c}) * 1e0 / count(*) AS {c}" for c in _RAIN_ALL)


@query(
    f"WITH s AS (SELECT {_SHARES} FROM joined), "
    f"st AS (SELECT CASE WHEN greatest({', '.join(_RAIN_ALL)}) <= 0.01 THEN 'empty' WHEN least({', '.join(_RAIN_ALL)}) <= 0.05 THEN 'low' ELSE 'ok' END AS status FROM s) "
    + _each(_RAIN_ALL, "SELECT '{c}' AS \"column\", {c} AS coverage, status FROM s, st"),
    "coverage",
)
def weather_coverage(t):
    return agg.weather_coverage(_joined(t))


@query(
    "SELECT count(*) FILTER (wqi_class = 'Excellent') * 1e2 / count(*) + count(*) FILTER (wqi_class = 'Good') * 1e2 / count(*) * 0.8 AS health_score, "
    "count(*) FILTER (wqi >= 60) * 1e2 / count(*) AS compliance_pct, greatest(0, 100 - stddev_samp(wqi) * 2) AS stability, stddev_samp(wqi) AS wqi_std FROM scored",
    "health_score compliance_pct stability wqi_std",
)
def health_score(t):
    return agg.health_score(t.scored)


def _health_sql(c, test, high, mid, low, upper, lower):
    return (
        f"SELECT '{c}' AS parameter, mean, pct AS within_pct, CASE WHEN pct >= {upper} THEN '{high}' WHEN pct >= {lower} THEN '{mid}' ELSE '{low}' END AS status "
        f"FROM (SELECT avg({c}) AS mean, count(*) FILTER ({test}) * 1e2 / count(*) AS pct FROM readings) x"
    )


@query(
    " UNION ALL ".join(
        [
            _health_sql("ph", "ph >= 6.5 AND ph <= 8.5", "Optimal", "Acceptable", "Concerning", 80, 60),
            _health_sql("do_mgl", "do_mgl >= 5", "Good", "Moderate", "Low", 70, 50),
            _health_sql("turbidity", "turbidity <= 5", "Clear", "Moderate", "Cloudy", 70, 50),
            _health_sql("conductance", "conductance <= 1500", "Normal", "Elevated", "High", 70, 50),
        ]
    ),
    "mean within_pct",
)
def parameter_health(t):
    return agg.parameter_health(t.readings)


_NEWEST = "arg_max(wqi, (timestamp, record_number))"


@query(
    f"WITH {RECENT}, c AS (SELECT wqi AS cur FROM recent {ORDERED} LIMIT 1) "
    "SELECT (SELECT cur FROM c) AS current, avg(wqi) AS mean, min(wqi) AS min, max(wqi) AS max, max(wqi) - min(wqi) AS range, "
    "(SELECT cur FROM c) - avg(wqi) AS current_minus_mean, count(*) FILTER (wqi_class = 'Excellent') * 1e2 / count(*) AS excellent_pct, "
    "count(*) FILTER (wqi_class = 'Good') * 1e2 / count(*) AS good_pct, count(*) FILTER (wqi_class IN ('Poor', 'Very Poor')) * 1e2 / count(*) AS alert_pct FROM recent",
    "current mean min max range current_minus_mean excellent_pct good_pct alert_pct",
)
def recent_status(t):
    return agg.recent_status(t.scored)


@query(
    f"WITH {RECENT}, a AS (SELECT count(*) FILTER (wqi_class = 'Very Poor') AS very_poor, "
    "count(*) FILTER (turbidity > (SELECT quantile_cont(turbidity, 0.95) FROM scored)) AS high_turbidity, "
    "count(*) FILTER (ph < 6.5 OR ph > 8.5) AS ph_out FROM recent) SELECT *, very_poor + high_turbidity + ph_out AS total FROM a"
)
def recent_alerts(t):
    return agg.recent_alerts(t.scored)


@query(
    f"WITH {RECENT} " + _each(PARAMS, "SELECT '{c}' AS parameter, avg({c}) AS mean, min({c}) AS min, max({c}) AS max, stddev_samp({c}) AS std FROM recent"),
    "mean min max std",
)
def recent_stats(t):
    return agg.recent_stats(t.scored, PARAMS)


@query(
    _each(
        PARAMS,
        "SELECT '{c}' AS parameter, round_even(avg({c}), 3) AS mean, round_even(stddev_samp({c}), 3) AS std, "
        "round_even(min({c}), 3) AS min, round_even(max({c}), 3) AS max FROM readings",
    ),
    "mean std min max",
)
def feature_stats(t):
    return agg.feature_stats(t.readings, PARAMS)


def _target_sql(c, target, g0, g1, a0, a1):
    return (
        f"SELECT '{c}' AS parameter, m AS mean, {target} AS target, m - {target} AS delta, CASE WHEN m BETWEEN {g0} AND {g1} THEN 'good' "
        f"WHEN m BETWEEN {a0} AND {a1} THEN 'acceptable' WHEN m IS NOT NULL THEN 'outside' END AS band FROM (SELECT avg({c}) AS m FROM recent) x"
    )


@query(
    f"WITH {RECENT} "
    + " UNION ALL ".join([_target_sql("ph", 7, 6.5, 8.5, 6, 9), _target_sql("do_mgl", 8, 6, 10, 4, 12), _target_sql("turbidity", 2, 0, 5, 0, 10)]),
    "mean target delta",
)
def target_gauge(t):
    return agg.target_gauge(t.scored)


@query(
    f"WITH c AS (SELECT wqi AS cur FROM scored {ORDERED} LIMIT 1), m AS (SELECT avg(wqi) AS mean FROM scored) "
    "SELECT cur AS current, mean, cur - mean AS delta, CASE WHEN cur IS NULL THEN NULL WHEN cur < 40 THEN 'below 40' WHEN cur < 60 THEN '40-60' "
    "WHEN cur < 80 THEN '60-80' ELSE '80 and above' END AS zone FROM c, m",
    "current mean delta",
)
def index_gauge(t):
    return agg.index_gauge(t.scored)


@query(
    _each(
        BIG_PARAMS,
        "SELECT '{c}' AS parameter, CASE WHEN max({c}) - min({c}) > 0 THEN ((SELECT {c} FROM readings ORDER BY timestamp DESC, record_number DESC LIMIT 1) - min({c})) * 1e2 / "
        "(max({c}) - min({c})) ELSE 50 END AS current, 85 AS target FROM readings",
    ),
    "current target",
)
def latest_profile(t):
    return agg.latest_profile(t.readings, BIG_PARAMS)


_FLOW_CLASSES = "(VALUES ('Excellent'), ('Good'), ('Poor'), ('Very Poor'))"


@query(
    "WITH n AS (SELECT wqi_class, row_number() OVER (ORDER BY timestamp, record_number) - 1 AS rn, count(*) OVER () AS total FROM scored), "
    "a AS (SELECT wqi_class AS f, count(*) AS ca FROM n WHERE rn < total // 2 GROUP BY 1), "
    "b AS (SELECT wqi_class AS g, count(*) AS cb FROM n WHERE rn >= total // 2 GROUP BY 1) "
    "SELECT f AS from_class, g AS to_class, least(ca, cb) // 3 AS flow FROM a CROSS JOIN b WHERE f <> 'Unknown' AND g <> 'Unknown' AND least(ca, cb) // 3 > 0"
)
def half_flow(t):
    return agg.half_flow(t.scored)


_PARTS = [f"{c}_contrib" for c in BIG_PARAMS]


@query(
    "WITH l AS (SELECT * FROM scored ORDER BY timestamp DESC, record_number DESC LIMIT 1), p AS ("
    + _each(BIG_PARAMS, "SELECT '{c}' AS component, {c}_contrib AS value FROM l")
    + ") SELECT component, value FROM p UNION ALL SELECT 'Total', sum(value) FROM p",
    "value",
)
def latest_contributions(t):
    return agg.latest_contributions(t.scored)


@query(
    _each(
        BIG_PARAMS,
        "SELECT s.day, '{c}' AS component, coalesce(avg({c}_contrib), 0) AS value FROM spine s LEFT JOIN scored r ON CAST(r.timestamp AS DATE) = s.day GROUP BY s.day",
    ),
    "value",
)
def contribution_series(t):
    return agg.contribution_series(t.scored)


@query(
    "SELECT parameter, CASE WHEN p5 < p95 THEN p5 WHEN lo < hi THEN lo ELSE mid - 1 END AS low, CASE WHEN p5 < p95 THEN p95 WHEN lo < hi THEN hi ELSE mid + 1 END AS high, "
    "mid AS median FROM (" + _each(
        PARAMS,
        "SELECT '{c}' AS parameter, quantile_cont({c}, 0.05) AS p5, quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.5) AS mid, min({c}) AS lo, max({c}) AS hi FROM readings",
    ) + ") r",
    "low high median",
)
def feature_ranges(t):
    return agg.feature_ranges(t.readings, PARAMS)


@query(
    "SELECT record_number, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in _TYPES if c not in ("timestamp", "record_number"))
    + " FROM readings ORDER BY timestamp, record_number LIMIT 500"
)
def null_matrix(t):
    return agg.null_matrix(t.readings)


@query(
    f"WITH r AS (SELECT wqi, row_number() OVER ({ORDERED}) AS rn FROM scored) SELECT avg(wqi) FILTER (rn <= 7) AS last_7, "
    "avg(wqi) FILTER (rn <= 30) AS last_30, avg(wqi) FILTER (rn <= 90) AS last_90, avg(wqi) AS overall FROM r",
    "last_7 last_30 last_90 overall",
)
def period_means(t):
    return agg.period_means(t.scored)


@query(
    "SELECT wqi_class, count(temperature) AS n, avg(temperature) AS mean, var_samp(temperature) AS variance FROM scored "
    "WHERE temperature IS NOT NULL GROUP BY 1",
    "mean variance",
)
def param_profile_by_class(t):
    return agg.group_moments(t.scored, "temperature")


_FIRST_MONTH = "date_trunc('month', timestamp) = (SELECT min(date_trunc('month', timestamp)) FROM readings_big)"


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", quantile_cont({c}, 1e-3) AS low, quantile_cont({c}, 2.5e-1) AS q1, quantile_cont({c}, 5e-1) AS median, "
        f"quantile_cont({c}, 7.5e-1) AS q3, quantile_cont({c}, 9.99e-1) AS high FROM readings_big WHERE {_FIRST_MONTH}"
        for c in BIG_PARAMS
    ),
    "low q1 median q3 high",
)
def quantiles_from_sketches(t):
    """Quantiles of the first month from daily sketches that two updates made; the month's readings are read once."""
    df = t.readings_big.select("timestamp", "order_id", *BIG_PARAMS)
    sketches = DailySketches(t.spark, scratch_path(t.spark, "sketches"), list(BIG_PARAMS))
    sketches.update(df.where("order_id % 2 = 0"), 1)
    sketches.update(df.where("order_id % 2 = 1"), 2)
    month = sketches.days().agg(F.date_trunc("month", F.min("day")).cast("date"), F.last_day(F.min("day"))).first()
    found = sketches.quantiles(df, (0.001, 0.25, 0.5, 0.75, 0.999), *month)
    rows = [(c, *answers) for c, answers in found.items()]  # one row a column
    return t.spark.createDataFrame(rows, "column string, low double, q1 double, median double, q3 double, high double")
