"""How models are trained: rows of Spark's forest in even parts, members and kinds side by side."""

import threading

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from envspark.operators import modelling as ml
from envspark.operators.boosting import HistogramBoosting
from workloads import QUERIES, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 40, 1_500), rng.normal(size=1_500)
    cells = [(i, float(x), float(z), float(x % 7 + z)) for i, (x, z) in enumerate(zip(a, b))]
    return spark.createDataFrame(cells, "id long, a double, b double, y double").coalesce(1).cache()


def test_forest_rows_are_dealt_evenly(spark, rows, monkeypatch):
    """A table of one part is learned from in a task for each core; how its rows come changes nothing, nor do kept node numbers."""
    given, fit = [], RandomForestRegressor._fit
    monkeypatch.setattr(ml, "FOREST_ROWS", 100)
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, df: given.append(df) or fit(self, df))
    settings = {"trees": 6, "depth": 6}
    model = ml.train(rows, "y", ["a", "b"], "rf_quick", **settings)
    cores = spark.sparkContext.defaultParallelism
    assert given[0].rdd.getNumPartitions() == min(cores, 15) > 1
    sizes = [r["count"] for r in given[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_500 and max(sizes) < 3 * min(sizes)
    again = ml.train(rows.orderBy(F.desc("b")).repartition(5), "y", ["a", "b"], "rf_quick", **settings)
    assert again.stages[-1].toDebugString.split("\n", 1)[1] == model.stages[-1].toDebugString.split("\n", 1)[1]
    walked = RandomForestRegressor(labelCol="y", seed=42, maxDepth=6, numTrees=6).fit(given[0])
    assert walked.toDebugString.split("\n", 1)[1] == model.stages[-1].toDebugString.split("\n", 1)[1]


def test_filled_rows_of_one_row_group_are_dealt_evenly(spark, monkeypatch, tmp_path):
    """What a model with filled gaps is split, cleaned and trained from has a part for each core, though its file is one row group."""
    given, split = [], models.chrono_split
    monkeypatch.setattr(ml, "FOREST_ROWS", 100)
    monkeypatch.setattr(models, "chrono_split", lambda df: given.append(df) or split(df))
    spark.range(1_600).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts", "id % 50 AS user_id", "'error' AS event_type",
        "CAST(id % 97 AS DOUBLE) AS value", "concat('{\"k\": ', id % 100, '}') AS props",
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    scored = QUERIES["batch_predict_filled"](spark, str(tmp_path))
    sizes = [r["count"] for r in given[0].groupBy(F.input_file_name()).count().collect()]
    known = 1_600 - 107
    assert sum(sizes) == known and len(sizes) == min(spark.sparkContext.defaultParallelism, known // 100) > 1 and max(sizes) < 3 * min(sizes)
    assert scored.where("scored").count() == scored.count() == 299


def test_members_train_side_by_side(rows, monkeypatch):
    """Both boosted members are in training at once, and come out as if trained alone."""
    members = {"gbt_plain": {"rounds": 3, "depth": 2, "l2": 0.0}, "gbt": {"rounds": 2, "depth": 3}}
    alone = [HistogramBoosting(inputCols=["a", "b"], labelCol="y", **m).fit(rows) for m in members.values()]
    met, fit = threading.Barrier(2, timeout=60), HistogramBoosting._fit
    monkeypatch.setattr(HistogramBoosting, "_fit", lambda self, df: (met.wait(), fit(self, df))[1])
    model = ml.train(rows, "y", ["a", "b"], "ensemble", members=members)
    assert [m.getOrDefault("state") for m in model.stages[1:]] == [m.getOrDefault("state") for m in alone]
    assert [m.getPredictionCol() for m in model.stages[1:]] == ["prediction_0", "prediction_1"]


def test_kinds_train_side_by_side(spark, monkeypatch):
    kinds = {"gbt_quick": {"rounds": 2}, "gbt_leaf": {"rounds": 2}}
    df = spark.range(200).select(
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"), F.col("id").alias("record_number"), (F.col("id") % 9).cast("double").alias("ph"),
        (F.col("id") % 9 + F.col("id") % 4).cast("double").alias("turbidity"),
    )
    met, fit = threading.Barrier(2, timeout=60), HistogramBoosting._fit
    monkeypatch.setattr(HistogramBoosting, "_fit", lambda self, data: (met.wait(), fit(self, data))[1])
    found = {r["model"]: r for r in ml.compare_models(df, "turbidity", kinds, features=["ph"]).collect()}
    monkeypatch.setattr(HistogramBoosting, "_fit", fit)
    prepared, features = ml.prepare_features(df, features=["ph"])
    for kind, settings in kinds.items():
        assert found[kind] == ml.evaluate(prepared, "turbidity", features, kind, **settings)[1].first()
