"""Regression on sensor readings with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import and_

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..defaults import ORDER
from ..functions.calendar import ordinal
from ..functions.numeric import bounded, percent, ratio
from ..sources.catalog import numeric_columns
from .boosting import HistogramBoosting
from .clean import covered_columns
from .deep_forest import DeepForest
from .fitted import caps_and_medians
from .scale import last_n, written
from .series import chrono_split, lag_features
from .topk import random_split

# Feature lists of the simple model and of the one with filled gaps, and settings of each model kind.
SIMPLE_FEATURES = ("ph", "conductance", "temperature", "do_mgl", "salinity", "rainfall", "date_num")
FILLED_FEATURES = (
    "temperature", "do_mgl", "do_sat", "ph", "salinity", "conductance", "turbidity", "chlorophyll", "water_speed", "water_direction",
)
#: A task that rows are dealt to has so many at least.
FOREST_ROWS = 4_096
#: Ending of the names of cleaned features inside a model.
CLEANED = "__cleaned"
SETTINGS = {
    # Every split looks at all features; the simple model has no depth limit.
    "rf": {"trees": 150, "depth": 15, "min_split": 5},
    "rf_deep": {"trees": 150, "min_split": 2},
    "rf_quick": {"trees": 50, "depth": 10, "min_rows": 2},
    # Second-order boosting level by level, its interactive size, leaf by leaf, and without penalty.
    "gbt": {"rounds": 150, "depth": 6, "step": 0.1, "l2": 1.0},
    "gbt_quick": {"rounds": 50, "depth": 5, "step": 0.1, "l2": 1.0},
    "gbt_leaf": {"rounds": 50, "depth": 5, "step": 0.1, "l2": 0.0, "leaves": 31, "leastRows": 20.0},
    "gbt_plain": {"rounds": 100, "depth": 5, "step": 0.1, "l2": 0.0},
}
ENSEMBLE = {
    "rf": {"trees": 100, "depth": 12, "min_rows": 2},
    "gbt_plain": SETTINGS["gbt_plain"],
    "gbt": {"rounds": 100, "depth": 6, "step": 0.3, "l2": 1.0},
}


def feature_names(df: DataFrame, target: str, core: int = 6) -> list[str]:
    """Weather columns first, then up to ``core`` sensor columns (no index, key or derived columns)."""
    derived = ("_q", "_contrib", "_quality", "_lag_")
    names = numeric_columns(df, exclude=("record_number", "wqi", "month", "year", "seq", target))
    weather = [c for c in names if c.startswith("rain")]
    sensors = [c for c in names if c not in weather and not any(t in c for t in derived)]
    return weather + sensors[:core]


def prepare_features(
    df: DataFrame,
    target: str = "turbidity",
    lags: int = 2,
    min_coverage: float = 0.01,
    last: int | None = None,
    features: Sequence[str] | None = None,
    order: Sequence[str] = ORDER,
    site: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Rows without gaps with the order key, features, target lags and target.

    The lags look at rows with a known target only. All rows are used unless
    ``last`` asks for the newest ones.
    """
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    chosen = list(features or feature_names(df, target))
    keys = [site, *order] if site else list(order)
    known = df.where(F.col(target).isNotNull()).select(*keys, *chosen, target)
    lagged = lag_features(known, target, lags, order, site) if lags else known
    chosen += [f"{target}_lag_{k}" for k in range(1, lags + 1)]
    kept = covered_columns(lagged, chosen, min_coverage)
    rows = lagged.select(*order, *kept, target).na.drop(subset=[*kept, target])
    return (last_n(rows, last, order) if last else rows), kept


def simple_features(df: DataFrame, target: str = "turbidity", order: Sequence[str] = ORDER) -> tuple[DataFrame, list[str]]:
    """Sensor values and the day number, for the model without lags."""
    dated = df.withColumn("date_num", ordinal(F.col(order[0])))
    names = [c for c in SIMPLE_FEATURES if c in dated.columns and c != target]
    return dated.select(*order, *names, target).na.drop(subset=[*names, target]), names


def _regressor(kind: str, target: str, features: Sequence[str], seed: int, settings: Mapping):
    if kind.startswith("rf"):
        return RandomForestRegressor(
            featuresCol="features", labelCol=target, seed=seed, maxDepth=settings["depth"], numTrees=settings["trees"],
            # A split leaves at least half of the smallest node that may be split on each side.
            minInstancesPerNode=max(1, settings.get("min_rows", 2) // 2),
            # Rows keep their node in each tree, so that a pass doesn't go down all trees from the root. They are kept on disk
            # where memory is short, so nothing is checkpointed.
            cacheNodeIds=True, checkpointInterval=-1,
        )
    if kind.startswith("gbt"):
        return HistogramBoosting(inputCols=list(features), labelCol=target, **settings)
    raise ValueError(f"unknown model kind: {kind}")


def dealt(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` in even parts, a task for each core: a small file, or a row group of any size, is one task in every pass over it.

    A part's rows and their order follow from ``key``, so Spark's forest, which takes parts as they come, draws the same rows on every
    run with as many cores. Runs a bounded count.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    found = rows.limit(cores * FOREST_ROWS).count()
    return rows.repartition(max(1, min(cores, found // FOREST_ROWS)), *key).sortWithinPartitions(*key)


def _side_by_side(work: Callable, items: Iterable) -> list:
    """``work`` of each item in threads of their own: while one model waits for its pass to begin or end, another's tasks run."""
    items = list(items)
    if len(items) < 2:
        return [work(item) for item in items]
    with ThreadPool(len(items)) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), items, chunksize=1)


def train(
    rows: DataFrame,
    target: str,
    features: Sequence[str],
    kind: str = "rf",
    seed: int = 42,
    min_rows: int = 30,
    clean: bool = False,
    **settings,
) -> PipelineModel | DeepForest | None:
    """Fit one model; ``None`` with fewer than ``min_rows`` rows. ``settings`` override SETTINGS[kind].

    ``kind="ensemble"`` fits a forest and two kinds of boosted trees, side by side, whose predictions are averaged.
    With ``clean`` the pipeline begins with caps and medians of these rows, so that rows with
    missing features are learned from and scored as well; not for forests of ``DeepForest``.
    """
    if rows.limit(min_rows).count() < min_rows:
        return None
    key = [c for c in rows.columns if c not in features and c != target] or list(rows.columns)
    if kind in ("rf", "rf_deep"):
        return DeepForest(features, target, key, seed=seed, **{**SETTINGS[kind], **settings}).fit(rows)
    cleaning = []
    if clean:
        cleaned = [f"{c}{CLEANED}" for c in features]
        cleaning = caps_and_medians(rows, features, cleaned)
        features = cleaned
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep" if clean else "error")
    if kind == "ensemble":
        members = settings.get("members", ENSEMBLE)
        stages = [_regressor(k, target, features, seed, m) for k, m in members.items()]
        for i, stage in enumerate(stages):
            stage.set(stage.predictionCol, f"prediction_{i}")
    else:
        stages = [_regressor(kind, target, features, seed, {**SETTINGS[kind], **settings})]
    head = Pipeline(stages=[*cleaning, assembler]).fit(rows)

    def fitted(stage):
        return stage.fit(head.transform(dealt(rows, key) if isinstance(stage, RandomForestRegressor) else rows))

    return PipelineModel(stages=[*head.stages, *_side_by_side(fitted, stages)])


def predict(model: PipelineModel | DeepForest, df: DataFrame, cleaned: bool = False) -> DataFrame:
    """Adds ``prediction`` to every row, in one pass; it is NULL where a feature is missing.

    With ``cleaned`` the feature columns are as the model's cleaning steps leave them, without as they were.
    """
    if isinstance(model, DeepForest):
        return model.predict(df)
    features = model_features(model)
    steps = model.stages
    while not isinstance(steps[0], VectorAssembler):
        df, steps = steps[0].transform(df), steps[1:]
    complete = reduce(and_, [bounded(F.col(c).cast("double")).isNotNull() for c in features])
    # Rows with gaps go through the model as well, so that no row is read twice.
    assembler = steps[0].copy({steps[0].handleInvalid: "keep"})
    scored = PipelineModel(stages=[assembler, *steps[1:]]).transform(df).drop("features")
    members = [c for c in scored.columns if c.startswith("prediction_") and c not in df.columns]
    value = sum((F.col(c) for c in members), F.lit(0.0)) / len(members) if members else F.col("prediction")
    scored = scored.withColumn("prediction", F.when(complete, value)).drop(*members)
    return _with_cleaned(scored, features) if cleaned else scored.drop(*[c for c in features if c.endswith(CLEANED)])


def model_features(model: PipelineModel) -> list[str]:
    """The columns a model learned from, cleaned ones by their cleaned names."""
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()


def cleaned_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with its feature columns as the model's cleaning steps leave them."""
    for step in model.stages:
        if isinstance(step, VectorAssembler):
            break
        df = step.transform(df)
    return _with_cleaned(df, model_features(model))


def _with_cleaned(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Cleaned columns in the place of those they were made from."""
    cells = {c.removesuffix(CLEANED): F.col(c) for c in features if c.endswith(CLEANED)}
    return df.withColumns(cells).drop(*[f"{c}{CLEANED}" for c in cells])


def filled_features(df: DataFrame, target: str = "turbidity", order: Sequence[str] = ORDER) -> tuple[DataFrame, list[str]]:
    """Rows with a target and all sensor columns that are there, gaps left for the model's own medians."""
    names = [c for c in FILLED_FEATURES if c in df.columns and c != target]
    return df.select(*order, *names, target).where(F.col(target).isNotNull()), names


def save_model(model: PipelineModel | DeepForest, path: str) -> None:
    if isinstance(model, DeepForest):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | DeepForest:
    try:
        return DeepForest.load(SparkSession.active(), path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    return PipelineModel.load(path)


def regression_metrics(scored: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """RMSE, R² and MAE in one pass."""
    error = F.col(target) - F.col(prediction)
    complete = scored.where(F.col(target).isNotNull() & F.col(prediction).isNotNull())
    n = F.count(F.lit(1))
    spread = F.var_pop(target) * n
    return complete.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - ratio(F.sum(error * error), spread)).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        n.alias("test_rows"),
    )


def evaluate(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    kind: str,
    test: float = 0.2,
    order: Sequence[str] = ORDER,
    split: str = "time",
    **settings,
) -> tuple[PipelineModel | DeepForest | None, DataFrame]:
    """Train on the older rows, score the newer ones; the model and one metrics row.

    ``split="random"`` tells training and test rows apart by a hash of the last
    column of ``order`` instead.
    """
    if split not in ("time", "random"):
        raise ValueError(f"unknown split: {split}")
    older, newer = chrono_split(df, test, order) if split == "time" else random_split(df, test, order[-1])
    return _evaluated(older, newer, target, features, kind, **settings)


def _evaluated(
    older: DataFrame, newer: DataFrame, target: str, features: Sequence[str], kind: str, **settings
) -> tuple[PipelineModel | DeepForest | None, DataFrame]:
    model = train(older, target, features, kind, **settings)
    head = [F.lit(kind).alias("model"), F.lit(target).alias("target")]
    if model is None:
        empty = "double rmse, double r2, double mae, bigint train_rows, bigint test_rows"
        row = older.sparkSession.range(1).select(
            *head,
            *[F.lit(None).cast(t).alias(n) for t, n in (p.split() for p in empty.split(", "))],
            F.lit("insufficient data").alias("status"),
        )
        return None, row
    rows = older.agg(F.count(F.lit(1)).alias("train_rows"))
    metrics = regression_metrics(predict(model, newer), target)
    return model, metrics.select(
        *head, "rmse", "r2", "mae", rows.scalar().alias("train_rows"), "test_rows", F.lit("ok").alias("status")
    )


def compare_models(
    df: DataFrame,
    target: str,
    kinds: Mapping[str, Mapping] | Sequence[str] = ("rf", "gbt", "ensemble"),
    test: float = 0.2,
    order: Sequence[str] = ORDER,
    **prepare,
) -> DataFrame:
    """One metrics row per model kind, all on the same prepared table (written and split once), trained side by side."""
    kinds = kinds if isinstance(kinds, Mapping) else {k: {} for k in kinds}
    rows, features = prepare_features(df, target, order=order, **prepare)
    rows = written(rows, "features")
    older, newer = chrono_split(rows, test, order)
    each = _side_by_side(lambda kind: _evaluated(older, newer, target, features, kind, **kinds[kind])[1], kinds)
    return reduce(DataFrame.unionByName, each)


def recommend(metrics: DataFrame) -> DataFrame:
    """The model with the best R² and the one with the best RMSE among those that trained."""
    trained = metrics.where("status = 'ok'")
    return trained.agg(
        F.max_by("model", "r2").alias("best_r2_model"),
        F.max("r2").alias("best_r2"),
        F.min_by("model", "rmse").alias("best_rmse_model"),
        F.min("rmse").alias("best_rmse"),
    ).where("best_r2 IS NOT NULL")


def importance(model: PipelineModel | DeepForest, spark) -> DataFrame:
    """Feature importance, share, rank and running share; one row per feature."""
    if isinstance(model, DeepForest):
        names, values = model.features, model.importances()
    else:
        names = [c.removesuffix(CLEANED) for c in model_features(model)]
        values = model.stages[-1].featureImportances.toArray()
    table = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
    return rank_importance(table)


def rank_importance(table: DataFrame) -> DataFrame:
    """Rank of each feature, its share in percent and the running share of the best ones."""
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.desc("importance"), "feature")
    share = percent(F.col("importance"), F.sum("importance").over(everything))
    return (
        table.withColumn("pct", share)
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("running_pct", F.sum("pct").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    )
