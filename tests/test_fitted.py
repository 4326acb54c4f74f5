"""Cleaning steps as pipeline stages: learned on one part, saved, applied to another."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from envspark.operators import fitted, modelling as ml
from envspark.operators.fitted import DayNumber, MedianFiller, OutlierCapper
from envspark.operators.scale import written

NAN, INF = float("nan"), float("inf")


def test_caps_and_medians_come_from_the_rows_fitted_on(spark, tmp_path):
    train = spark.createDataFrame([(float(i), None if i % 2 else float(-i), None) for i in range(1, 1001)], "a double, b double, c double")
    steps = [OutlierCapper(inputCols=["a", "b", "c"], lower=0.01, upper=0.99), MedianFiller(inputCols=["a", "b", "c"], outputCols=["a", "b2", "c2"])]
    model = Pipeline(stages=steps).fit(train)
    model.write().save(f"{tmp_path}/m")
    other = spark.createDataFrame([(-5.0, NAN, 1.0), (5000.0, None, None), (None, -1e9, INF), (700.0, -700.0, -2.0)], "a double, b double, c double")
    got = [tuple(r) for r in PipelineModel.load(f"{tmp_path}/m").transform(other).select("a", "b", "b2", "c2").collect()]
    low, high = 1 + 0.01 * 999, 1 + 0.99 * 999
    b_low = -1000 + 0.01 * 998
    assert got == [
        pytest.approx((low, None, -501.0, 1.0)), pytest.approx((high, None, -501.0, None)), pytest.approx((500.5, b_low, b_low, None)), (700.0, -700.0, -700.0, -2.0),
    ]
    assert model.stages[0].values["c"] is None


def test_wrong_settings(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(ValueError):
        OutlierCapper(inputCols=["a"], lower=0.9, upper=0.1).fit(df)
    with pytest.raises(ValueError):
        MedianFiller(inputCols=["a"], outputCols=["x", "y"]).fit(df).transform(df)


def test_day_number(spark):
    df = spark.sql("SELECT DATE'0001-01-01' AS d, TIMESTAMP_NTZ'2024-01-01 23:00:00' AS t")
    row = DayNumber(inputCols=["d", "t"], outputCols=["dn", "tn"]).transform(df).first()
    assert (row.dn, row.tn) == (1, 738886)


@pytest.mark.parametrize("kind, settings", [("gbt_quick", {"rounds": 3}), ("gbt_leaf", {"rounds": 3}), ("rf_quick", {"trees": 3}), ("ensemble", {"members": {"rf": {"trees": 2, "depth": 3}, "gbt": {"rounds": 2}}})])
def test_clean_models_score_rows_with_gaps(spark, tmp_path, kind, settings):
    rows = spark.range(200).select(
        F.col("id").alias("record_number"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 7 * 1.0).alias("b"),
        F.lit(None).cast("double").alias("never"), (F.col("id") * 2.0).alias("y"),
    )
    model = ml.train(rows, "y", ["a", "b"], kind, clean=True, **settings)
    ml.save_model(model, f"{tmp_path}/m")
    scored = ml.predict(ml.load_model(f"{tmp_path}/m"), rows)
    assert scored.columns == [*rows.columns, "prediction"]
    assert scored.where("prediction IS NULL").count() == 0
    first = scored.where("record_number = 0").first()
    assert first.a is None and first.b is None  # the caller's columns stay as they were
    assert ml.cleaned_features(model, rows).where("a IS NULL OR b IS NULL").count() == 0
    # Without cleaning, rows with gaps have no prediction.
    plain = ml.train(rows.na.drop(subset=["a", "b"]), "y", ["a", "b"], kind, **settings)
    assert ml.predict(plain, rows).where("prediction IS NULL").count() == rows.where("a IS NULL OR b IS NULL").count()
    if kind != "ensemble":
        assert {r.feature for r in ml.importance(model, spark).collect()} == {"a", "b"}


def test_caps_and_medians_come_from_one_search(spark, monkeypatch):
    """The steps of a model are as if learned one after the other; rows are searched once for both."""
    rows = spark.range(1_001).select(
        "id", (F.col("id") * 1.0).alias("y"), F.when(F.col("id") % 3 > 0, F.pow(F.col("id") % 101 - 50.0, F.lit(3))).alias("a"), F.lit(7.0).alias("b"),
        F.when(F.col("id") % 2 > 0, F.lit(INF)).when(F.col("id") % 5 == 0, F.lit(NAN)).otherwise(-F.col("id").cast("double")).alias("c"),
        F.when(F.col("id") < 4, F.col("id") * 10.0).alias("d"), F.lit(None).cast("double").alias("never"),
    )
    names = ["a", "b", "c", "d", "never"]
    outs = [f"{n}{ml.CLEANED}" for n in names]
    apart = Pipeline(stages=[OutlierCapper(inputCols=names, outputCols=outs), MedianFiller(inputCols=outs)]).fit(rows)
    searches, search = [], fitted.exact_quantiles
    monkeypatch.setattr(fitted, "exact_quantiles", lambda *args: searches.append(args) or search(*args))
    model = ml.train(rows, "y", names, "gbt_quick", clean=True, rounds=1)
    assert len(searches) == 1
    for step, want in zip(model.stages, apart.stages):
        assert type(step) is type(want) and step.pairs() == want.pairs()
        assert step.values == {n: v and pytest.approx(v) for n, v in want.values.items()}


@pytest.mark.parametrize("kind, settings", [("gbt_quick", {"rounds": 3}), ("rf_quick", {"trees": 3}), ("ensemble", {"members": {"rf": {"trees": 2, "depth": 3}, "gbt": {"rounds": 2}}})])
@pytest.mark.parametrize("clean", [True, False])
def test_rows_are_read_once_to_score_them(spark, kind, settings, clean):
    """Rows with gaps and without come in one pass, cleaned ones in the same; rows of one number stay apart."""
    rows = written(
        spark.range(300).select(
            F.floor(F.col("id") / 2).alias("record_number"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).when(F.col("id") % 2 > 0, F.lit(INF)).alias("a"),
            F.when(F.col("id") % 5 > 0, F.col("id") % 7 * 1.0).alias("b"), (F.col("id") * 2.0).alias("y"),
        )
    )
    model = ml.train(rows if clean else rows.where("abs(a) < 1e9 AND b IS NOT NULL"), "y", ["a", "b"], kind, clean=clean, **settings)
    scored = ml.predict(model, rows, cleaned=True)
    assert scored.columns == [*rows.columns, "prediction"]
    assert scored._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = [tuple(r) for r in scored.orderBy("y").collect()]
    cells = ml.cleaned_features(model, rows).orderBy("y").collect()
    assert [g[:-1] for g in got] == [tuple(r) for r in cells]
    # A row alone, without gaps, is predicted alike.
    whole = ml.cleaned_features(model, rows).where("abs(a) < 1e9 AND b IS NOT NULL")
    alone = {r.y: r.prediction for r in ml.predict(model, whole).collect()}
    assert {g[-2]: g[-1] for g in got if g[-1] is not None} == pytest.approx(alone)
    assert len(alone) == (300 if clean else rows.where("abs(a) < 1e9 AND b IS NOT NULL").count())
