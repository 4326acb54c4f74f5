"""Correlation, tests and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.operators import anomaly, correlation as corr, forest, hypothesis

from .registry import query
from .views import BIG_PARAMS, PARAMS

_ALL = (*PARAMS, "chlorophyll")


def _r(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return (
        f"covar_samp({x}, {y}) FILTER ({both}) / nullif(stddev_samp({x}) FILTER ({both}) * stddev_samp({y}) FILTER ({both}), 0)"
    )


def _pearson(columns, source) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS param_1, '{b}' AS param_2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, {_r(a, b)} AS corr FROM {source}"
        for a in columns
        for b in columns
    )


def _spearman(columns, source) -> str:
    def pair(a, b):
        ranks = ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS r{i}" for i, c in enumerate((a, b))
        )
        return (
            f"SELECT '{a}' AS param_1, '{b}' AS param_2, count(*) AS n, covar_samp(r0, r1) / nullif(stddev_samp(r0) * stddev_samp(r1), 0) AS corr "
            f"FROM (SELECT {ranks} FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) x"
        )

    return " UNION ALL ".join(pair(a, b) for a in columns for b in columns)


@query(_spearman(_ALL, "readings"), "corr")
def spearman(t):
    return corr.correlation(t.readings, _ALL)


_BIG = f"(SELECT {', '.join(BIG_PARAMS)} FROM readings_big)"


@query(_spearman(BIG_PARAMS, _BIG), "corr")
def spearman_big(t):
    return corr.spearman(t.readings_big, BIG_PARAMS)


@query(_spearman(BIG_PARAMS, _BIG), "corr")
def spearman_big_shuffled(t):
    """The same through the shuffle join, values above 1,000 rows joined apart."""
    return corr.spearman(t.readings_big, BIG_PARAMS, broadcast_cells=0, hot_rows=1_000)


@query(_pearson(_ALL, "readings"), "corr")
def pearson(t):
    return corr.correlation(t.readings, _ALL, "pearson")


@query(_pearson(BIG_PARAMS, "readings_big"), "corr")
def pearson_big(t):
    return corr.pearson(t.readings_big, BIG_PARAMS)


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS param_1, '{b}' AS param_2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, true AS enough FROM readings"
        for a in _ALL
        for b in _ALL
    )
)
def pair_counts(t):
    return corr.pair_counts(t.readings, _ALL)


@query(
    f"SELECT param_1, param_2, n, corr FROM ({_pearson(PARAMS, 'readings')}) m WHERE param_1 < param_2 AND abs(corr) >= 0.01 "
    "ORDER BY round(abs(corr), 9) DESC, param_1, param_2 LIMIT 10",
    "corr",
)
def top_correlations(t):
    return corr.top_correlations(corr.pearson(t.readings, PARAMS), 0.01, 10)


@query(
    f"SELECT avg(m) AS mean_abs_corr FROM (SELECT param_2, avg(abs(corr)) AS m FROM ({_pearson(_ALL, 'readings')}) p GROUP BY param_2) q",
    "mean_abs_corr",
)
def mean_abs_corr(t):
    return corr.mean_abs_correlation(t.readings, _ALL)


_ANOVA = (
    "WITH g AS (SELECT wqi_class, count(temperature) AS n, avg(temperature) AS m, var_samp(temperature) AS v FROM scored WHERE temperature IS NOT NULL GROUP BY 1), "
    "s AS (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb, sum((n - 1) * coalesce(v, 0)) AS ssw FROM g), "
    "f AS (SELECT groups, n, groups - 1 AS df_between, n - groups AS df_within, (ssb / (groups - 1)) / (ssw / (n - groups)) AS f_statistic FROM s) "
)


# With five groups (four degrees of freedom between them) the p value has the closed form x^a (1 + a (1 - x)).
@query(
    _ANOVA + "SELECT *, p_value < 0.05 AS significant FROM (SELECT *, pow(x, a) * (1 + a * (1 - x)) AS p_value FROM "
    "(SELECT *, df_within / 2e0 AS a, df_within / (df_within + df_between * f_statistic) AS x FROM f) y) z",
    "f_statistic p_value a x",
)
def anova(t):
    result = hypothesis.anova(t.scored, "temperature")
    x = F.col("df_within") / (F.col("df_within") + F.col("df_between") * F.col("f_statistic"))
    return result.withColumns({"a": F.col("df_within") / 2.0, "x": x})


_T_TEST = (
    "WITH r AS (SELECT turbidity AS v, row_number() OVER (ORDER BY timestamp DESC, record_number DESC) AS rn FROM readings), "
    "a AS (SELECT count(v) FILTER (rn <= 30) AS n1, count(v) FILTER (rn BETWEEN 31 AND 60) AS n2, avg(v) FILTER (rn <= 30) AS m1, "
    "avg(v) FILTER (rn BETWEEN 31 AND 60) AS m2, var_samp(v) FILTER (rn <= 30) AS v1, var_samp(v) FILTER (rn BETWEEN 31 AND 60) AS v2 FROM r) "
)


@query(
    _T_TEST + "SELECT n1 AS n_recent, n2 AS n_historical, m1 AS mean_recent, m2 AS mean_historical, "
    "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1e0 / n1 + 1e0 / n2)) AS t_statistic FROM a",
    "mean_recent mean_historical t_statistic",
)
def t_test(t):
    return hypothesis.t_test(t.readings, "turbidity", p_value=False)


# 30 known values on either side leave 58 degrees of freedom; for an even number the p value is a finite sum.
@query(
    _T_TEST.replace("FROM readings)", "FROM readings WHERE turbidity IS NOT NULL)")
    + ", t AS (SELECT n1, n2, m1, m2, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1e0 / n1 + 1e0 / n2)) AS t, "
    "n1 + n2 - 2 AS f FROM a), "
    "p AS (SELECT any_value(n1) AS n_recent, any_value(n2) AS n_historical, any_value(m1) AS mean_recent, any_value(m2) AS mean_historical, "
    "any_value(t) AS t_statistic, 1 - any_value(abs(t) / sqrt(f + t * t)) * "
    "sum(exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) + CASE WHEN k = 0 THEN 0 ELSE k * ln(f / (f + t * t) / 4) END)) AS p_value "
    "FROM t, (SELECT unnest(range(29)) AS k) s) SELECT *, p_value < 0.05 AS significant FROM p",
    "mean_recent mean_historical t_statistic p_value",
)
def t_test_p_value(t):
    return hypothesis.t_test(t.readings.where("turbidity IS NOT NULL"), "turbidity")


@query(
    "WITH s AS (SELECT avg(turbidity) AS m, stddev_samp(turbidity) AS d FROM readings) "
    "SELECT record_number, turbidity, m - 1.5 * d AS lower_bound, m + 1.5 * d AS upper_bound, coalesce(abs((turbidity - m) / d) > 1.5, false) AS anomaly FROM readings, s",
    "turbidity lower_bound upper_bound",
)
def zscore_anomaly(t):
    return anomaly.zscore_flag(t.readings, "turbidity", 1.5).select(
        "record_number", "turbidity", "lower_bound", "upper_bound", "anomaly"
    )


_FENCE = (
    "SELECT quantile_cont({c}, 0.25) - {m} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
    "quantile_cont({c}, 0.75) + {m} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {s}"
)


@query(
    f"WITH f AS ({_FENCE.format(c='turbidity', m=1.0, s='readings')}) "
    "SELECT record_number, turbidity, lo AS lower_bound, hi AS upper_bound, coalesce(turbidity < lo OR turbidity > hi, false) AS anomaly FROM readings, f",
    "turbidity lower_bound upper_bound",
)
def iqr_anomaly(t):
    return anomaly.iqr_flag(t.readings, "turbidity", 1.0).select(
        "record_number", "turbidity", "lower_bound", "upper_bound", "anomaly"
    )


def _report(c: str, source: str, whole: str) -> str:
    return (
        f"SELECT '{c}' AS parameter, count(*) FILTER ({c} < lo OR {c} > hi) AS outliers, "
        f"coalesce(round_even(count(*) FILTER ({c} < lo OR {c} > hi) * 1e2 / nullif({whole.format(c=c)}, 0), 2), 0) AS outlier_pct, "
        f"round_even(any_value(lo), 2) AS lower_bound, round_even(any_value(hi), 2) AS upper_bound "
        f"FROM {source}, ({_FENCE.format(c=c, m=1.5, s=source)}) f"
    )


@query(" UNION ALL ".join(_report(c, "readings", "count({c})") for c in _ALL), "outlier_pct lower_bound upper_bound")
def outlier_report(t):
    return anomaly.outlier_report(t.readings, _ALL)


@query(" UNION ALL ".join(_report(c, "readings_big", "count(*)") for c in BIG_PARAMS), "outlier_pct lower_bound upper_bound")
def outlier_report_big(t):
    return anomaly.outlier_report(t.readings_big, BIG_PARAMS, of_all_rows=True)


@query(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS parameter, count(*) FILTER ({c} > lim) AS extreme, any_value(lim) AS threshold FROM readings, (SELECT avg({c}) + 3 * stddev_samp({c}) AS lim FROM readings) l"
        for c in PARAMS[:5]
    ) + ") r WHERE extreme > 0",
    "threshold",
)
def upper_3sigma(t):
    return anomaly.upper_three_sigma(t.readings, PARAMS[:5])


_FLAGGED = (
    "WITH s AS (SELECT avg(turbidity) AS m, stddev_samp(turbidity) AS d FROM scored), "
    "f AS (SELECT *, coalesce(abs((turbidity - m) / d) > 1.5, false) AS anomaly FROM scored, s) "
)


@query(
    _FLAGGED + "SELECT count(*) FILTER (anomaly) AS anomalies, count(*) FILTER (anomaly) * 1e2 / count(*) AS anomaly_pct, avg(turbidity) AS mean, "
    "avg(turbidity) FILTER (anomaly) AS anomaly_mean FROM f",
    "anomaly_pct mean anomaly_mean",
)
def anomaly_summary(t):
    return anomaly.anomaly_summary(anomaly.zscore_flag(t.scored, "turbidity", 1.5), "turbidity")


@query(
    _FLAGGED + "SELECT timestamp, record_number, turbidity, wqi, wqi_class FROM f WHERE anomaly ORDER BY timestamp DESC, record_number DESC LIMIT 10",
    "turbidity wqi",
)
def recent_anomalies(t):
    flagged = anomaly.zscore_flag(t.scored, "turbidity", 1.5)
    return anomaly.recent_anomalies(flagged, ["turbidity", "wqi", "wqi_class"])


@query(
    _FLAGGED + "SELECT timestamp, record_number, turbidity FROM f WHERE anomaly ORDER BY timestamp, record_number LIMIT 10", "turbidity"
)
def first_outliers(t):
    return anomaly.first_outliers(anomaly.zscore_flag(t.scored, "turbidity", 1.5), ["turbidity"])


@query(None)
def isolation_forest(t):
    return forest.isolation_flag(t.readings, "conductance").select("record_number", "conductance", "score", "anomaly")
