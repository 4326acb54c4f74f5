"""Hand-made tables with values worked out by hand or by pandas."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from envspark.functions.numeric import parse_number
from envspark.functions.quality import classify, combine
from envspark.operators import (
    aggregate as agg,
    align,
    anomaly,
    clean,
    correlation as corr,
    distribution as dist,
    forest,
    hypothesis,
    modelling as ml,
    series as ops,
    topk,
)
from envspark.plans.enrich import calendar_features, enrich, process_weather, wqi
from envspark.sources import catalog, metrics, tables
from envspark.defaults import DEVIATION_CUTS, GAUSSIAN_CUTS


def values(df, column, by):
    return [r[column] for r in df.orderBy(by).collect()]


# ---------------------------------------------------------------- cleaning


def test_grouped_numbers(spark):
    df = spark.createDataFrame([("1,200",), ("",), ("x",), (None,), ("NaN",)], "c string")
    got = [r[0] for r in df.select(parse_number(F.col("c"), strip_grouping=True)).collect()]
    assert got == [1200.0, None, None, None, None]


def test_coerce_keeps_mostly_text_columns(spark):
    df = spark.createDataFrame([("Rainy", "1"), ("Sunny", "x"), ("Dry", "3")], "weather string, amount string")
    kept = clean.coerce_numeric(df, min_parse_share=0.5)
    assert dict(kept.dtypes) == {"weather": "string", "amount": "double"}
    every = clean.coerce_numeric(df)
    assert [r.weather for r in every.collect()] == [None] * 3


def test_coerce_leaves_dates_keys_and_flags(spark):
    df = spark.createDataFrame([("a", "b", "c", "4")], ["Timestamp", "Record number", "pH [quality]", "pH"])
    assert [t for _, t in clean.coerce_numeric(df).dtypes] == ["string", "string", "string", "double"]


def test_cap_keeps_nulls_and_bounds(spark):
    data = [float(i) for i in range(1001)] + [None]
    df = spark.createDataFrame([(v, None) for v in data], "v double, empty double")
    got = clean.cap_outliers(df, q=(0.01, 0.99)).agg(F.min("v"), F.max("v"), F.count("v"), F.count("empty")).first()
    assert tuple(got) == (10.0, 990.0, 1001, 0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 300])
def test_cap_and_fill_equals_both_steps(spark, n):
    rng = np.random.default_rng(n)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(size=n) ** 3)] + [(n, None)], "i int, v double")
    for tail in (0.001, 0.1):
        a = values(clean.cap_and_fill(df, ["v"], tail), "v", "i")
        b = values(clean.impute(clean.cap_outliers(df, ["v"], q=(tail, 1 - tail)), ["v"]), "v", "i")
        np.testing.assert_allclose(a, b, atol=1e-12)


def test_impute_methods(series):
    df = series([None, 1.0, None, 4.0, None])
    assert values(clean.impute(df, ["v"]), "v", "record_number") == [2.5, 1.0, 2.5, 4.0, 2.5]
    assert values(clean.impute(df, ["v"], "mean"), "v", "record_number") == [2.5, 1.0, 2.5, 4.0, 2.5]
    assert values(clean.impute(df, ["v"], "ffill_bfill"), "v", "record_number") == [1.0, 1.0, 1.0, 4.0, 4.0]
    assert values(clean.impute(df, ["v"], "zero"), "v", "record_number") == [0.0, 1.0, 0.0, 4.0, 0.0]
    with pytest.raises(ValueError):
        clean.impute(df, ["v"], "guess")


def test_coverage_filter(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert clean.covered_columns(df, ["a", "b"]) == ["a"]
    with pytest.raises(ValueError):
        clean.covered_columns(df, ["b"])


def test_climatology(spark):
    df = spark.createDataFrame(
        [(date(2022, 1, 1), 1.0), (date(2022, 1, 2), 2.0), (date(2022, 2, 1), 3.0), (None, 99.0)], "date date, rainfall double"
    )
    got = clean.climatology_fill(df, "2024-01-31", "2024-03-01", ["rainfall"])
    rows = {r.date: r for r in got.collect()}
    assert len(rows) == 31
    assert rows[date(2024, 1, 31)].rainfall == 1.5
    assert rows[date(2024, 1, 31)].rainfall_std == pytest.approx(0.5**0.5)
    # February has one value and takes the overall deviation, March takes everything overall.
    assert (rows[date(2024, 2, 10)].rainfall, rows[date(2024, 2, 10)].rainfall_std) == (3.0, 1.0)
    assert (rows[date(2024, 3, 1)].rainfall, rows[date(2024, 3, 1)].rainfall_std) == (2.0, 1.0)


def test_interpolation(spark):
    days = [date(2024, 1, d) for d in range(1, 6)]
    daily = spark.createDataFrame(list(zip(days, [None, 1.0, None, 3.0, None])), "day date, v double")
    assert values(ops.interpolate_daily(daily, "v"), "v", "day") == [None, 1.0, 2.0, 3.0, 3.0]


def test_daily_mean_opens_gaps(series):
    df = series([1.0, 4.0], step_hours=72)
    assert values(agg.daily_mean(df, ["v"]), "v", "day") == [1.0, None, None, 4.0]


# ---------------------------------------------------------------- sources


def test_csv_round_trip_with_junk_row(spark, tmp_path):
    (tmp_path / "w.csv").write_text(
        "date,rainfall,temperature,humidity,wind_speed,weather_condition\n"
        "2022-01-01,12.5,15.2,78,8.5,Rainy\n2022-01-02,8.2,17.8,65,5.2,Rainy\n2022-01-03,0,20.1,52,3.1,Sunny\nCo,,,,,\n"
    )
    weather = tables.read_weather(spark, str(tmp_path / "w.csv"))
    got = process_weather(weather).where("date IS NOT NULL").orderBy("date").collect()
    assert [(r.rainfall, r.humidity, r.weather_condition) for r in got] == [
        (12.5, 78.0, "Rainy"),
        (8.2, 65.0, "Rainy"),
        (0.0, 52.0, "Sunny"),
    ]
    first = got[0]
    assert (first.year, first.month, first.day_of_week, first.day_of_week_num, first.is_weekend, first.day_of_year, first.season) == (
        2022, 1, "Saturday", 5, 1, 1, "Winter",
    )
    assert "hour" not in got[0].asDict()
    junk = process_weather(weather).where("date IS NULL").first()
    assert (junk.season, junk.is_weekend) == (None, None)
    daily = align.weather_daily(clean.coerce_numeric(weather, min_parse_share=0.5))
    assert daily.count() == 3


def test_discovery(spark):
    df = spark.createDataFrame([(f"x{i}", f"2024-01-{i + 1:02d}") for i in range(8)], ["name", "when"])
    assert catalog.timestamp_column(df) == "when"
    assert catalog.timestamp_column(df.withColumnRenamed("name", "Date_Time")) == "Date_Time"
    assert catalog.site_column(df) is None
    assert catalog.site_column(df.withColumnRenamed("name", "Station")) == "Station"
    assert catalog.first_column_as_date(df).columns == ["date", "when"]


def test_read_readings_names(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Timestamp,Record number,Dissolved Oxygen (%Saturation),pH [quality]\n2024-01-01 10:00:00,7,88.5,OK\nCo,8,,\n")
    df = tables.read_readings(spark, str(tmp_path / "r.csv"))
    assert df.columns == ["timestamp", "record_number", "do_sat", "ph_quality"]
    assert [r.timestamp for r in df.orderBy("record_number").collect()] == [datetime(2024, 1, 1, 10), None]


METRICS = {
    "rf_turbidity_metrics": "RandomForest — Turbidity\nRMSE: 1.0111\nR²: -1.7894\nMAE: 0.8102\nTrain: 1600 | Test: 400\n",
    "xgb_dissolved_oxygen_metrics": "XGBoost — Dissolved Oxygen\nRMSE: 0.0168\nR²: 0.9989\nMAE: 0.0062\nTrain: 1200 | Test: 800\n",
    "empty_metrics": "Nothing here\n",
    "bare_metrics": "Forest\nRMSE: 2.5\nR²: n/a\n",
}


def test_scan_metrics(spark, tmp_path):
    for name, text in METRICS.items():
        (tmp_path / f"{name}.txt").write_text(text)
    got = {r.model: r for r in metrics.scan_metrics(spark, str(tmp_path)).collect()}
    assert set(got) == {"rf_turbidity_metrics", "xgb_dissolved_oxygen_metrics", "bare_metrics"}
    r = got["rf_turbidity_metrics"]
    assert (r.model_type, r.target, r.rmse, r.r2, r.mae, r.train_rows, r.test_rows) == (
        "RandomForest", "Turbidity", 1.0111, -1.7894, 0.8102, 1600, 400,
    )
    assert (got["bare_metrics"].target, got["bare_metrics"].r2) == ("Unknown", None)


def test_metrics_text_files(spark, tmp_path):
    schema = "model string, target string, rmse double, r2 double, mae double, train_rows bigint, test_rows bigint"
    rows = [("GBT", "ph", 0.25, -0.5, 0.125, 80, 20), ("GBT", "Dissolved Oxygen", 0.5, 0.5, 0.25, 80, 20), (None, "ph", 1.0, 0.1, 0.5, 8, 2)]
    metrics.write_metrics(spark.createDataFrame(rows, schema), str(tmp_path), fmt="text")
    # A second run of a model replaces its file and leaves the others.
    metrics.write_metrics(spark.createDataFrame([("GBT", "ph", 0.125, 0.5, 0.0625, 90, 10)], schema), str(tmp_path), fmt="text")
    metrics.write_metrics(spark.createDataFrame([], schema), str(tmp_path), fmt="text")
    names = ["gbt_dissolved_oxygen_metrics", "gbt_ph_metrics", "unknown_ph_metrics"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [f"{n}.txt" for n in names]
    got = {r.model: r for r in metrics.scan_metrics(spark, str(tmp_path)).collect()}
    assert sorted(got) == names
    assert (got[names[1]].rmse, got[names[1]].train_rows, got[names[0]].target) == (0.125, 90, "Dissolved Oxygen")


def test_metrics_text_round_trip(spark):
    row = spark.createDataFrame(
        [("GBT", "ph", 0.25, -0.5, 0.125, 80, 20)], "model string, target string, rmse double, r2 double, mae double, train_rows bigint, test_rows bigint"
    )
    text = row.select(metrics.metrics_text(F.col("model"), F.col("target")).alias("value"))
    assert text.first()[0] == "GBT — ph\nRMSE: 0.2500\nR²: -0.5000\nMAE: 0.1250\nTrain: 80 | Test: 20"
    assert tuple(metrics.parse_metrics(text).first()) == ("GBT", "ph", 0.25, -0.5, 0.125, 80, 20)


# ---------------------------------------------------------------- index


def test_deviation_index_by_hand(spark):
    df = spark.createDataFrame([(8.5, 5.0, 1500.0, 4.0), (7.0, 0.0, 0.0, 8.0), (7.0, None, 0.0, 8.0)], "ph double, turbidity double, conductance double, do_mgl double")
    got = wqi(df).collect()
    assert [(r.wqi and round(r.wqi, 9), r.wqi_class) for r in got] == [(100.0, "Very Poor"), (0.0, "Excellent"), (None, "Unknown")]
    assert sum(got[0][f"{c}_contrib"] for c in df.columns) == pytest.approx(got[0].wqi)


def test_absent_columns_renormalise(spark):
    df = spark.createDataFrame([(8.5, 2.5)], "ph double, turbidity double")
    assert wqi(df).first().wqi == pytest.approx((100 * 0.25 + 50 * 0.35) / 0.6)
    with pytest.raises(ValueError):
        wqi(df.select(F.lit(1).alias("other")))


def test_gaussian_null_policies(spark):
    df = spark.createDataFrame([(7.0, 0.1, 500.0, 8.0), (7.0, None, 500.0, 8.0)], "ph double, turbidity double, conductance double, do_mgl double")
    def got(policy):
        return [(r.wqi and round(r.wqi, 6), r.wqi_class) for r in wqi(df, "gaussian", null_policy=policy).collect()]

    assert got("null") == [(100.0, "Excellent"), (None, "Unknown")]
    assert got("zero") == [(100.0, "Excellent"), (0.0, "Very Poor")]
    assert got("renormalise") == [(100.0, "Excellent"), (100.0, "Excellent")]


def test_class_cuts_run_both_ways(spark):
    df = spark.createDataFrame([(v,) for v in (25.0, 25.1, 75.0, 80.0, None)], "v double")
    assert [r[0] for r in df.select(classify(F.col("v"), DEVIATION_CUTS)).collect()] == ["Excellent", "Good", "Poor", "Very Poor", "Unknown"]
    assert [r[0] for r in df.select(classify(F.col("v"), GAUSSIAN_CUTS)).collect()] == ["Very Poor", "Very Poor", "Good", "Excellent", "Unknown"]


def test_health_direction(spark):
    df = spark.createDataFrame([(10.0, "Excellent"), (70.0, "Poor")], "wqi double, wqi_class string")
    assert agg.health_score(df).first().compliance_pct == 50.0
    assert agg.health_score(df, 60.0, higher_is_better=False).first().compliance_pct == 50.0
    assert agg.health_score(df, 5.0, higher_is_better=False).first().compliance_pct == 0.0


# ---------------------------------------------------------------- statistics


def test_corrected_moments(series):
    got = agg.shape_stats(series([1.0, 2.0, 2.0, 9.0]), ["v"]).first()
    assert got.skewness == pytest.approx(1.9001038155)
    got = agg.shape_stats(series([1.0, 2.0, 2.0, 9.0, 3.0]), ["v"]).first()
    assert got.kurtosis == pytest.approx(4.0691865397)
    assert agg.shape_stats(series([5.0, 5.0, 5.0, 5.0]), ["v"]).first().skewness is None


def test_short_series_guards(series):
    scored = lambda n: series([float(i) for i in range(n)], "wqi")
    assert ops.trend_7v7(scored(13)).first().trend == 0.0
    assert ops.trend_7v7(scored(14)).first().trend == 7.0
    assert ops.recent_share(scored(99)).first().recent_pct == 0.0
    assert ops.recent_share(scored(100)).first().recent_pct == 40.0
    assert hypothesis.t_test(scored(59), "wqi").count() == 0
    assert hypothesis.t_test(scored(60), "wqi").count() == 1
    assert tuple(agg.period_means(scored(29)).first())[:2] == (25.0, 0.0)


def test_t_and_f_agree(spark, series):
    data = [1.0, 2.0, 3.0, 4.0, 6.0, 8.0]
    groups = ["a"] * 3 + ["b"] * 3
    df = spark.createDataFrame(list(zip(data, groups)), "v double, wqi_class string")
    got = hypothesis.anova(df, "v").first()
    # Means 2 and 6, within sums 2 and 8: F = (6·4) / (10/4) = 9.6.
    assert got.f_statistic == pytest.approx(9.6)
    assert got.p_value == pytest.approx(0.0363, abs=5e-4)
    assert got.significant
    t = hypothesis.t_test(series(data), "v", rows=3).first()
    assert t.t_statistic**2 == pytest.approx(9.6)
    assert t.p_value == pytest.approx(got.p_value)
    assert hypothesis.anova(df.where("wqi_class = 'a'"), "v").count() == 0


def test_incomplete_beta_known_values():
    assert hypothesis.incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)
    assert hypothesis.incomplete_beta(2, 1, 0.3) == pytest.approx(0.09)
    assert hypothesis.incomplete_beta(5, 2, 0.4) == pytest.approx(6 * 0.4**5 * 0.6 + 0.4**6)
    # Two-sided p of t = 2.262157 with 9 degrees of freedom is 0.05.
    assert hypothesis.incomplete_beta(4.5, 0.5, 9 / (9 + 2.262157**2)) == pytest.approx(0.05, abs=1e-6)


@pytest.fixture
def gappy(spark):
    rng = np.random.default_rng(5)
    n = 300
    data = pd.DataFrame({"a": rng.integers(0, 9, n).astype(float), "b": rng.normal(size=n), "c": rng.normal(size=n)})
    data["c"] = data["c"] + data["b"]
    data.loc[rng.random(n) < 0.2, "a"] = np.nan
    data.loc[rng.random(n) < 0.1, "c"] = np.nan
    data["d"] = 1.0
    rows = [(datetime(2024, 1, 1), i, *[None if pd.isna(x) else float(x) for x in r]) for i, r in enumerate(data.to_numpy())]
    return data, spark.createDataFrame(rows, "timestamp timestamp_ntz, record_number bigint, a double, b double, c double, d double")


@pytest.mark.parametrize("settings", [{}, {"broadcast_cells": 0, "hot_rows": 20}, {"broadcast_cells": 0}])
def test_spearman_equals_pandas(gappy, settings):
    data, df = gappy
    want = data.corr(method="spearman")
    got = corr.spearman(df.repartition(6), list("abcd"), **settings).collect()
    assert len(got) == 16
    for r in got:
        expected = want.loc[r.param_1, r.param_2]
        assert r["corr"] is None if np.isnan(expected) else r["corr"] == pytest.approx(expected, abs=1e-9)
        assert r.n == int((data[r.param_1].notna() & data[r.param_2].notna()).sum())


def test_pearson_equals_pandas(gappy):
    data, df = gappy
    want = data.corr()
    for r in corr.pearson(df, list("abcd")).collect():
        expected = want.loc[r.param_1, r.param_2]
        assert r["corr"] is None if np.isnan(expected) else r["corr"] == pytest.approx(expected, abs=1e-9)
    top = corr.top_correlations(corr.pearson(df, list("abcd")), 0.3).collect()
    assert [(r.param_1, r.param_2) for r in top] == [("b", "c")]


@pytest.mark.parametrize("period,ends", [(7, 3), (4, 2)])
def test_decomposition(series, period, ends):
    values_ = [float(i % period) + i for i in range(14)]
    got = ops.decompose(series(values_, step_hours=24), "v", period).orderBy("day").collect()
    assert [r.trend is None for r in got] == [i < ends or i >= 14 - ends for i in range(14)]
    assert sum(r.seasonal for r in got[:period]) == pytest.approx(0, abs=1e-9)
    for r in got[ends:-ends]:
        assert r.observed == pytest.approx(r.trend + r.seasonal + r.residual)
        assert r.residual == pytest.approx(0, abs=1e-9)
    assert ops.decompose(series(values_[: 2 * period - 1], step_hours=24), "v", period).count() == 0


def test_kde_binned_is_close_and_both_integrate_to_one(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(x),) for x in rng.normal(size=500)], "v double")
    exact = dist.kde(df, "v").orderBy("point").collect()
    binned = dist.kde(df, "v", binned=True).orderBy("point").collect()
    assert max(abs(a.density - b.density) for a, b in zip(exact, binned)) < 1e-3
    area = np.trapezoid([r.density for r in exact], [r.x for r in exact])
    assert 0.95 < area < 1.0


def test_box_stats_by_hand(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    r = dist.box_stats(df, "v").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_anomaly_flags(series):
    df = series([float(i % 5) for i in range(100)] + [50.0, None])
    flagged = anomaly.iqr_flag(df, "v")
    assert anomaly.anomaly_summary(flagged, "v").first().anomalies == 1
    assert anomaly.normal_rows(flagged).count() == 101
    assert anomaly.zscore_flag(df, "v").where("anomaly").first().v == 50.0
    constant = anomaly.zscore_flag(series([1.0] * 5), "v")
    assert constant.where("anomaly").count() == 0
    assert anomaly.outlier_report(series([None, None]), ["v"]).first().outlier_pct == 0.0


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(11)
    data = [*rng.normal(size=990).tolist(), *[12.0, -15.0, 20.0, 30.0, -40.0, 9.0, 14.0, -11.0, 17.0, 25.0]]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(data)], "record_number bigint, v double")
    flagged = forest.isolation_flag(df, "v", trees=50, sample=20).collect()
    share = sum(r.anomaly for r in flagged) / len(flagged)
    assert 0.02 < share <= 0.05
    assert all(r.anomaly for r in flagged if r.record_number >= 990)
    again = forest.isolation_flag(df.repartition(3), "v", trees=50, sample=20).collect()
    assert {r.record_number: r.score for r in again} == {r.record_number: r.score for r in flagged}


# ---------------------------------------------------------------- alignment


def test_disjoint_weather_is_filled(spark, series):
    readings = series([1.0, 2.0], "ph", step_hours=24).withColumns(
        {c: F.lit(1.0) for c in ("turbidity", "conductance", "do_mgl")}
    )
    weather = spark.createDataFrame([(date(2022, 1, 1), 4.0, 1), (date(2022, 1, 1), 2.0, 2), (None, 9.0, 3)], "date date, rainfall double, seq bigint")
    got = enrich(readings, weather, cap=False, include_hour=False).orderBy("record_number").collect()
    assert [r.rainfall for r in got] == [6.0, 6.0]
    left = enrich(readings, weather, cap=False, fill_weather=False, impute_method=None)
    assert [r.rainfall for r in left.collect()] == [None, None]


def test_common_dates_and_ranges(spark, series):
    readings = series([1.0] * 4, step_hours=24)
    weather = spark.createDataFrame([(date(2024, 1, d),) for d in (3, 4, 5, 9)], "date date")
    assert sorted(r.date.day for r in align.common_dates(readings, weather).collect()) == [3, 4]
    assert tuple(align.date_coverage(readings, weather).first()) == (4, 7, 2, 50.0)
    a, b = align.align_ranges(readings, weather)
    assert (a.count(), b.count()) == (2, 2)


def test_weekdays_are_completed(series):
    got = agg.weekday_mean(series([1.0]), "v").collect()
    assert [r.day_name for r in got][0] == "Monday" and len(got) == 7
    assert [r["mean"] for r in got] == [1.0] + [None] * 6


# ---------------------------------------------------------------- models


def test_train_score_save_and_reload(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(datetime(2024, 1, 1 + i // 24, i % 24), i, float(x), float(2 * x + rng.normal() / 50)) for i, x in enumerate(rng.random(400))]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, record_number bigint, ph double, turbidity double")
    table, features = ml.prepare_features(df, "turbidity", features=["ph"])
    assert features == ["ph", "turbidity_lag_1", "turbidity_lag_2"] and table.count() == 398
    model, scores = ml.evaluate(table, "turbidity", features, "rf", trees=20, depth=6)
    row = scores.first()
    assert (row.status, row.train_rows, row.test_rows) == ("ok", 318, 80) and row.r2 > 0.9
    ml.save_model(model, str(tmp_path / "m"))
    loaded = ml.load_model(str(tmp_path / "m"))
    a, b = (sorted(r.prediction for r in ml.predict(m, table).collect()) for m in (model, loaded))
    assert a == b
    shares = ml.importance(model, spark).orderBy("rank").collect()
    assert shares[0].feature == "ph" and shares[-1].running_pct == pytest.approx(100)


def test_too_few_rows_give_no_model(series):
    df = series([float(i) for i in range(20)], "turbidity").withColumn("ph", F.col("turbidity"))
    rows, features = ml.prepare_features(df, "turbidity", features=["ph"])
    model, scores = ml.evaluate(rows, "turbidity", features, "rf")
    assert model is None and scores.first().status == "insufficient data"
    assert ml.recommend(scores).count() == 0
    with pytest.raises(ValueError):
        ml.prepare_features(df, "absent")


def test_random_split_and_sample_ignore_partitioning(series):
    df = series([float(i) for i in range(500)])
    train, test = topk.random_split(df)
    assert train.count() + test.count() == 500 and 70 <= test.count() <= 130
    a = {r.record_number for r in topk.random_sample(df, 50).collect()}
    b = {r.record_number for r in topk.random_sample(df.repartition(9), 50).collect()}
    assert a == b and len(a) == 50
