"""Ordered series, top rows and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.functions import calendar as cal
from envspark.operators import scale, series as ops, topk
from envspark.operators.aggregate import daily_mean, null_report
from envspark.operators.scale import scratch_path
from envspark.sources.ordered_table import OrderedTable

from .registry import query
from .views import PARAMS

W = "ORDER BY timestamp, record_number"
DESC = "ORDER BY timestamp DESC, record_number DESC"


def _rolled(column, frame, rows, fn="avg", by=""):
    w = f"OVER ({by} {W} ROWS BETWEEN {frame})"
    return f"CASE WHEN count({column}) {w} = {rows} THEN {fn}({column}) {w} END"


@query(
    f"SELECT timestamp, record_number, turbidity, {_rolled('turbidity', '3 PRECEDING AND 3 FOLLOWING', 7)} AS rolling_mean FROM readings",
    "turbidity rolling_mean",
)
def centered_mean(t):
    return ops.rolling(t.readings, "turbidity", rows=7, center=True).drop("position")


@query(
    f"SELECT record_number, {_rolled('conductance', '2 PRECEDING AND 1 FOLLOWING', 4)} AS rolling_mean FROM readings", "rolling_mean"
)
def centered_mean_even(t):
    return ops.rolling(t.readings, "conductance", rows=4, center=True).select("record_number", "rolling_mean")


@query(
    f"SELECT site, record_number, {_rolled('ph', '4 PRECEDING AND CURRENT ROW', 5, by='PARTITION BY site')} AS rolling_mean FROM readings",
    "rolling_mean",
)
def rolling_by_site(t):
    return ops.rolling(t.readings, "ph", rows=5, site="site").select("site", "record_number", "rolling_mean")


@query(
    "SELECT record_number, wqi, m AS rolling_mean, s AS rolling_std, m + 1.96 * s AS upper, m - 1.96 * s AS lower FROM ("
    f"SELECT record_number, wqi, {_rolled('wqi', '3 PRECEDING AND 3 FOLLOWING', 7)} AS m, "
    f"{_rolled('wqi', '3 PRECEDING AND 3 FOLLOWING', 7, 'stddev_samp')} AS s FROM scored) x",
    "wqi rolling_mean rolling_std upper lower",
)
def wqi_bands(t):
    return ops.wqi_bands(t.scored).drop("timestamp", "position")


# Frames over rows that have an index; with gaps every seventh row no frame of ``wqi_bands`` is whole.
_INDEXED = "(SELECT * FROM scored WHERE wqi IS NOT NULL) k"


@query(
    "SELECT record_number, wqi, m AS rolling_mean, s AS rolling_std, m + 1.96 * s AS upper, m - 1.96 * s AS lower FROM ("
    f"SELECT record_number, wqi, {_rolled('wqi', '3 PRECEDING AND 3 FOLLOWING', 7)} AS m, "
    f"{_rolled('wqi', '3 PRECEDING AND 3 FOLLOWING', 7, 'stddev_samp')} AS s FROM {_INDEXED}) x",
    "wqi rolling_mean rolling_std upper lower",
)
def wqi_bands_known(t):
    return ops.wqi_bands(t.scored.where("wqi IS NOT NULL")).drop("timestamp", "position")


def _over_days(column: str, days: int, by: str = "") -> str:
    same = f"AND r.{by} IS NOT DISTINCT FROM d.{by} " if by else ""
    keys = f"{by}, " if by else ""
    return (
        f"SELECT {keys}day, avg(v) AS rolling_mean, stddev_samp(v) AS rolling_std FROM (SELECT d.*, r.{column} AS v FROM "
        f"(SELECT DISTINCT {keys}CAST(timestamp AS DATE) AS day FROM readings WHERE timestamp IS NOT NULL) d "
        f"JOIN readings r ON CAST(r.timestamp AS DATE) BETWEEN d.day - {days - 1} AND d.day {same}) x GROUP BY ALL"
    )


@query(_over_days("conductance", 7), "rolling_mean rolling_std")
def rolling_seven_days(t):
    return ops.rolling_days(t.readings, "conductance", 7, ("mean", "std"))


@query(_over_days("ph", 30, "site"), "rolling_mean rolling_std")
def rolling_thirty_days_by_site(t):
    return ops.rolling_days(t.readings, "ph", 30, ("mean", "std"), site="site")


@query(
    f"SELECT was AS source, wqi_class AS target, count(*) AS rows FROM (SELECT wqi_class, lag(wqi_class) OVER ({W}) AS was, "
    f"row_number() OVER ({W}) AS k FROM scored) x WHERE k > 1 GROUP BY 1, 2"
)
def class_transitions(t):
    return ops.class_transitions(t.scored)


DAILY = "d AS (SELECT s.day, avg({c}) AS {c} FROM spine s LEFT JOIN readings r ON CAST(r.timestamp AS DATE) = s.day GROUP BY s.day)"
BACK = "OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)"
AHEAD = "OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _interpolated(c: str) -> str:
    return (
        f"{DAILY.format(c=c)}, k AS (SELECT day, {c}, last_value({c} IGNORE NULLS) {BACK} AS y0, last_value(CASE WHEN {c} IS NOT NULL THEN day END IGNORE NULLS) {BACK} AS d0, "
        f"first_value({c} IGNORE NULLS) {AHEAD} AS y1, first_value(CASE WHEN {c} IS NOT NULL THEN day END IGNORE NULLS) {AHEAD} AS d1 FROM d), "
        f"i AS (SELECT day, CASE WHEN d0 IS NULL OR {c} IS NOT NULL THEN {c} WHEN d1 IS NULL THEN y0 "
        f"ELSE y0 + (y1 - y0) * datediff('day', d0, day) / datediff('day', d0, d1) END AS {c} FROM k)"
    )


@query(f"WITH {_interpolated('ph')} SELECT day, ph FROM i", "ph")
def interpolate_daily(t):
    return ops.interpolate_daily(daily_mean(t.readings, ["ph"]), "ph")


@query(
    f"WITH {_interpolated('turbidity')} SELECT day, turbidity, CASE WHEN count(turbidity) OVER w = least(7, (SELECT count(*) FROM i)) THEN avg(turbidity) OVER w END AS trailing_mean "
    "FROM i WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
    "turbidity trailing_mean",
)
def trailing_mean(t):
    return ops.daily_series(t.readings, "turbidity")


@query(
    f"SELECT record_number, {_rolled('wqi', '29 PRECEDING AND CURRENT ROW', 30, 'stddev_samp')} AS rolling_std FROM scored", "rolling_std"
)
def volatility(t):
    return ops.volatility(t.scored).select("record_number", "rolling_std")


@query(
    f"SELECT record_number, {_rolled('wqi', '29 PRECEDING AND CURRENT ROW', 30, 'stddev_samp')} AS rolling_std FROM {_INDEXED}",
    "rolling_std",
)
def volatility_known(t):
    return ops.volatility(t.scored.where("wqi IS NOT NULL")).select("record_number", "rolling_std")


@query(
    f"SELECT record_number, {_rolled('conductance', '29 PRECEDING AND CURRENT ROW', 30, 'stddev_samp')} AS rolling_std FROM "
    "(SELECT timestamp, record_number, coalesce(conductance, 0) AS conductance FROM readings) z",
    "rolling_std",
)
def volatility_filled(t):
    filled = t.readings.select("timestamp", "record_number", "conductance").fillna(0.0)
    return ops.volatility(filled, column="conductance").select("record_number", "rolling_std")


@query(
    f"SELECT record_number, turbidity, lag(turbidity, 1) OVER ({W}) AS turbidity_lag_1, lag(turbidity, 2) OVER ({W}) AS turbidity_lag_2 FROM readings",
    "turbidity turbidity_lag_1 turbidity_lag_2",
)
def lag_features(t):
    slim = t.readings.select("timestamp", "record_number", "turbidity")
    return ops.lag_features(slim, "turbidity").drop("timestamp")


@query(
    "WITH k AS (SELECT * FROM readings WHERE ph IS NOT NULL), "
    f"s AS (SELECT record_number, ph, list(ph) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS q FROM k) "
    "SELECT record_number, ph AS next_value, array_to_string(list_transform(q, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS sequence FROM s WHERE len(q) = 10",
    "next_value",
)
def sequences(t):
    made = ops.sequences(t.readings, "ph", 10)
    text = F.concat_ws(",", F.transform("sequence", lambda x: F.round(x * 100).cast("bigint").cast("string")))
    return made.select("record_number", "next_value", text.alias("sequence"))


@query(
    f"SELECT site, timestamp, record_number, ph FROM (SELECT *, row_number() OVER (PARTITION BY site {DESC}) AS rn FROM readings) x WHERE rn = 1",
    "ph",
)
def latest_per_site(t):
    return ops.latest_per_site(t.readings.select("site", "timestamp", "record_number", "ph"), "site")


@query(
    "WITH r AS (SELECT conductance, row_number() OVER (ORDER BY timestamp, record_number) AS a, row_number() OVER (ORDER BY timestamp DESC, record_number DESC) AS z "
    "FROM readings WHERE timestamp >= (SELECT max(timestamp) FROM readings) - INTERVAL 7 DAYS), "
    "e AS (SELECT max(CASE WHEN a = 1 THEN conductance END) AS first, max(CASE WHEN z = 1 THEN conductance END) AS last FROM r) "
    "SELECT first, last, last - first AS delta, CASE WHEN last > first THEN 'rising' WHEN last < first THEN 'falling' WHEN last = first THEN 'stable' END AS direction FROM e",
    "first last delta",
)
def first_last_delta(t):
    return ops.first_last_delta(t.readings, "conductance")


@query(
    f"WITH r AS (SELECT wqi, row_number() OVER ({DESC}) AS rn FROM scored) SELECT avg(wqi) FILTER (rn <= 7) - avg(wqi) FILTER (rn BETWEEN 8 AND 14) AS trend FROM r",
    "trend",
)
def trend_7v7(t):
    return ops.trend_7v7(t.scored)


@query(
    f"SELECT count(*) FILTER (wqi >= 60) * 1e0 / 100 * 100 AS recent_pct FROM (SELECT wqi FROM scored {DESC} LIMIT 100) x", "recent_pct"
)
def recent_share(t):
    return ops.recent_share(t.scored)


@query(
    f"SELECT record_number, turbidity, rn AS position FROM (SELECT record_number, turbidity, row_number() OVER ({W}) - 1 AS rn, count(*) OVER () AS n FROM readings) x "
    "WHERE rn % greatest(1, n // 500) = 0",
    "turbidity",
)
def every_kth_row(t):
    slim = t.readings.select("timestamp", "record_number", "turbidity")
    return ops.every_kth(slim, 500).drop("timestamp")


@query(f"SELECT timestamp, record_number, ph FROM readings {DESC} LIMIT 2000", "ph")
def last_n_rows(t):
    return scale.last_n(t.readings.select("timestamp", "record_number", "ph"), 2000)


def _decompose_sql(c: str, p: int) -> str:
    half = p // 2
    frame = f"OVER (ORDER BY day ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    ends = (
        f" - (lag(observed, {half}) OVER (ORDER BY day) + lead(observed, {half}) OVER (ORDER BY day)) / 2" if p % 2 == 0 else ""
    )
    return (
        f"WITH {DAILY.format(c=c)}, "
        f"o AS (SELECT day, coalesce(last_value({c} IGNORE NULLS) {BACK}, first_value({c} IGNORE NULLS) {AHEAD}) AS observed, row_number() OVER (ORDER BY day) - 1 AS i FROM d), "
        f"tr AS (SELECT *, CASE WHEN count(observed) {frame} = {2 * half + 1} THEN (sum(observed) {frame}{ends}) / {p} END AS trend FROM o), "
        f"s AS (SELECT i % {p} AS slot, avg(observed - trend) AS m FROM tr GROUP BY 1), "
        f"c AS (SELECT slot, m - (SELECT avg(m) FROM s) AS seasonal FROM s) "
        f"SELECT day, observed, trend, seasonal, observed - trend - seasonal AS residual FROM tr JOIN c ON c.slot = tr.i % {p}"
    )


@query(_decompose_sql("turbidity", 7), "observed trend seasonal residual")
def decompose(t):
    return ops.decompose(t.readings, "turbidity", 7)


@query(_decompose_sql("conductance", 4), "observed trend seasonal residual")
def decompose_even(t):
    return ops.decompose(t.readings, "conductance", 4)


@query("SELECT record_number, datediff('day', DATE '0001-01-01', CAST(timestamp AS DATE)) + 1 AS date_num FROM readings")
def date_ordinal(t):
    return t.readings.select("record_number", cal.ordinal(F.col("timestamp")).cast("bigint").alias("date_num"))


# ---------------------------------------------------------------- top rows and samples


@query(
    f"SELECT site, timestamp, record_number, wqi FROM (SELECT *, row_number() OVER (PARTITION BY site {DESC}) AS rn FROM scored) x WHERE rn = 1 "
    "ORDER BY wqi DESC NULLS LAST, site LIMIT 6",
    "wqi",
)
def top_sites(t):
    return topk.top_sites(t.scored, "site")


@query(
    "SELECT s.day, avg(wqi) AS wqi FROM spine s LEFT JOIN scored r ON CAST(r.timestamp AS DATE) = s.day GROUP BY s.day ORDER BY wqi DESC NULLS LAST, s.day LIMIT 6",
    "wqi",
)
def top_days(t):
    return topk.top_days(t.scored)


@query(
    "WITH n AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM readings" for c in (*PARAMS, "chlorophyll")
    ) + ") SELECT \"column\", nulls, row_number() OVER (ORDER BY nulls DESC, \"column\") AS place FROM n"
)
def sorted_reports(t):
    from pyspark.sql import Window

    report = null_report(t.readings.select(*PARAMS, "chlorophyll"))
    place = F.row_number().over(Window.orderBy(F.desc("nulls"), "column")).cast("bigint")
    return report.select("column", "nulls", place.alias("place"))


@query("SELECT record_number, ph FROM readings ORDER BY md5(CAST(record_number AS VARCHAR)), record_number LIMIT 1000", "ph")
def random_sample(t):
    return topk.random_sample(t.readings.select("record_number", "ph"), 1000)


@query(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, coalesce(var_samp({c}), 0) AS variance FROM readings" for c in (*PARAMS, "chlorophyll")
    ) + ") r ORDER BY non_null DESC, variance DESC LIMIT 5",
    "variance",
)
def rank_columns(t):
    return topk.rank_columns(t.readings, [*PARAMS, "chlorophyll"], 5)


@query(
    "SELECT timestamp, record_number, 'ph' AS parameter, ph AS value FROM readings UNION ALL SELECT timestamp, record_number, 'turbidity', turbidity FROM readings",
    "value",
)
def multi_series(t):
    return topk.multi_series(t.readings, ["ph", "turbidity"])


@query(
    f"SELECT timestamp, record_number, ph, CASE WHEN rn <= 30 THEN 'recent' ELSE 'historical' END AS period FROM (SELECT *, row_number() OVER ({DESC}) AS rn FROM readings) x WHERE rn <= 60",
    "ph",
)
def label_union(t):
    return topk.period_rows(t.readings, "ph")


@query(
    "SELECT count(*) FILTER (b >= 200000) AS train_rows, count(*) FILTER (b < 200000) AS test_rows FROM "
    "(SELECT CAST(concat('0x', substr(md5(CAST(record_number AS VARCHAR)), 1, 8)) AS BIGINT) % 1000000 AS b FROM readings) x"
)
def random_split(t):
    train, test = topk.random_split(t.readings.select("record_number"))
    rows = train.agg(F.count(F.lit(1)).alias("train_rows"))
    return rows.withColumn("test_rows", test.agg(F.count(F.lit(1))).scalar())


@query(
    f"SELECT record_number, CASE WHEN rn <= n - CAST(ceil(n * 0.2) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM (SELECT record_number, row_number() OVER ({W}) AS rn, count(*) OVER () AS n FROM readings) x"
)
def chrono_split(t):
    train, test = ops.chrono_split(t.readings.select("timestamp", "record_number"))
    return (
        train.withColumn("part", F.lit("train"))
        .unionByName(test.withColumn("part", F.lit("test")))
        .select("record_number", "part")
    )


@query(
    f"SELECT half, wqi_class, count(*) AS rows FROM (SELECT wqi_class, CASE WHEN row_number() OVER ({W}) <= count(*) OVER () // 2 THEN 'first' ELSE 'second' END AS half FROM scored) x GROUP BY 1, 2"
)
def half_counts(t):
    return ops.halves_label(t.scored).groupBy("half", "wqi_class").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- a table kept in order

_PLACED = f"SELECT *, row_number() OVER ({W}) - 1 AS position, count(*) OVER () AS n FROM readings"


def _ordered(t):
    slim = t.readings.select("timestamp", "record_number", "turbidity", "ph")
    # Small files, so that the test tables have several.
    return OrderedTable.write(slim, scratch_path(t.spark, "ordered-table"), file_rows=5_000)


@query(f"SELECT record_number, turbidity, position FROM ({_PLACED}) x WHERE position % greatest(1, n // 500) = 0", "turbidity")
def ordered_every_kth(t):
    return _ordered(t).every_kth(500).select("record_number", "turbidity", "position")


@query(
    f"SELECT 'newest' AS part, record_number, ph FROM ({_PLACED}) x WHERE position >= n - 2000 "
    f"UNION ALL SELECT 'first', record_number, ph FROM ({_PLACED}) x WHERE position < 100 "
    f"UNION ALL SELECT 'middle', record_number, ph FROM ({_PLACED}) x WHERE position = n // 2",
    "ph",
)
def ordered_ends(t):
    """The newest 2,000 rows, the first 100 and the middle one, each from the files that hold them."""
    table = _ordered(t)
    parts = {"newest": table.newest(2000), "first": table.first(100), "middle": table.kth(table.count() // 2)}
    rows = [df.select(F.lit(name).alias("part"), "record_number", "ph") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "SELECT record_number, CASE WHEN position < n - CAST(ceil(n * 0.2) AS BIGINT) THEN 'train' ELSE 'test' END AS part "
    f"FROM ({_PLACED}) x"
)
def ordered_split(t):
    train, test = _ordered(t).chrono_split()
    parts = [df.select("record_number", F.lit(name).alias("part")) for name, df in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])
