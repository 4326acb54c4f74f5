"""Features, training, scoring and model reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.defaults import ORDER
from envspark.operators import modelling as ml
from envspark.operators.boosting import MAX_BINS, HistogramBoosting
from envspark.operators.deep_forest import DeepForest
from envspark.operators.scale import scratch_path, written
from envspark.operators.series import chrono_split

from .align import _joined
from .registry import query
from .views import PARAMS

FEATURES = ["ph", "conductance", "do_mgl"]
# Model kinds of the interactive comparison.
INTERACTIVE = ("rf_quick", "gbt_quick", "gbt_leaf")
# Columns with few values, of which SQL can list all splits.
TREE_FEATURES = ["ph", "turbidity", "do_mgl"]


@query(
    "WITH k AS (SELECT timestamp, record_number, rainfall, ph, conductance, do_mgl, turbidity, lag(turbidity, 1) OVER w AS turbidity_lag_1, lag(turbidity, 2) OVER w AS turbidity_lag_2 "
    "FROM joined WHERE turbidity IS NOT NULL WINDOW w AS (ORDER BY joined.timestamp, record_number)) "
    "SELECT * FROM k WHERE rainfall IS NOT NULL AND ph IS NOT NULL AND conductance IS NOT NULL AND do_mgl IS NOT NULL AND turbidity_lag_1 IS NOT NULL AND turbidity_lag_2 IS NOT NULL",
    "rainfall ph conductance do_mgl turbidity turbidity_lag_1 turbidity_lag_2",
)
def prepare_features(t):
    rows, _ = ml.prepare_features(_joined(t), "turbidity", features=["rainfall", *FEATURES, "chlorophyll"])
    return rows


def _prepared(t):
    """All weather and sensor features with lags."""
    rows, features = ml.prepare_features(_joined(t), "turbidity")
    return written(rows, "features"), features


@query(None)
def random_forest(t):
    rows, features = _prepared(t)
    return ml.evaluate(rows, "turbidity", features, "rf")[1]


@query(None)
def random_forest_simple(t):
    rows, features = ml.simple_features(_joined(t))
    return ml.evaluate(written(rows, "features"), "turbidity", features, "rf_deep", split="random")[1]


@query(
    "SELECT ph, turbidity, do_mgl, count(*) AS n, avg(conductance) AS prediction FROM readings_big GROUP BY ph, turbidity, do_mgl",
    "ph turbidity do_mgl prediction",
)
def forest_grown_out(t):
    """A tree without depth limit on all rows ends where rows are alike, so it predicts the mean of each combination."""
    rows = t.readings_big.select(*TREE_FEATURES, "conductance", "order_id")
    forest = DeepForest(TREE_FEATURES, "conductance", ["order_id"], trees=1, bootstrap=False, gather_rows=20_000).fit(rows)
    return forest.predict(rows.groupBy(*TREE_FEATURES).agg(F.count(F.lit(1)).alias("n")))


@query(None)
def gradient_boosting(t):
    rows, features = _prepared(t)
    return ml.evaluate(rows, "turbidity", features, "gbt")[1]


def _best_cut(table: str, where: str) -> str:
    """The split with the greatest gain among the rows of ``table``; ``g`` is a row's gradient."""
    cells = " UNION ALL ".join(
        f"SELECT {i} AS f, '{c}' AS feature, {c} AS threshold, sum(g) AS g, count(*) AS n FROM {table} WHERE {where} GROUP BY {c}"
        for i, c in enumerate(TREE_FEATURES)
    )
    return (
        "SELECT feature, threshold, gain, n_left, n_all - n_left AS n_right, g_left, g_all - g_left AS g_right FROM ("
        "SELECT *, (g_left * g_left / (n_left + 1) + (g_all - g_left) * (g_all - g_left) / (n_all - n_left + 1) - g_all * g_all / (n_all + 1)) / 2 AS gain "
        "FROM (SELECT f, feature, threshold, sum(g) OVER a AS g_left, sum(n) OVER a AS n_left, sum(g) OVER b AS g_all, sum(n) OVER b AS n_all "
        f"FROM ({cells}) c WINDOW a AS (PARTITION BY f ORDER BY threshold), b AS (PARTITION BY f)) s WHERE n_all > n_left) t "
        "ORDER BY gain DESC, f, threshold LIMIT 1"
    )


_UNDER = "CASE (SELECT feature FROM r0) " + " ".join(f"WHEN '{c}' THEN {c}" for c in TREE_FEATURES) + " END <= (SELECT threshold FROM r0)"


@query(
    "WITH g0 AS (SELECT ph, turbidity, do_mgl, (SELECT avg(conductance) FROM readings_big) - conductance AS g FROM readings_big), "
    f"r0 AS ({_best_cut('g0', 'TRUE')}), g1 AS (SELECT *, {_UNDER} AS low FROM g0), "
    f"r1 AS ({_best_cut('g1', 'low')}), r2 AS ({_best_cut('g1', 'NOT low')}), "
    "leaf AS (SELECT 1 AS parent, r1.* FROM r1 UNION ALL SELECT 2, r2.* FROM r2) "
    "SELECT 0 AS node, NULL AS parent, feature, threshold, gain, (SELECT count(*) FROM g0) AS n, (SELECT -sum(g) / (count(*) + 1) FROM g0) AS value FROM r0 "
    "UNION ALL SELECT 1, 0, r1.feature, r1.threshold, r1.gain, CAST(r0.n_left AS BIGINT), -r0.g_left / (r0.n_left + 1) FROM r0, r1 "
    "UNION ALL SELECT 2, 0, r2.feature, r2.threshold, r2.gain, CAST(r0.n_right AS BIGINT), -r0.g_right / (r0.n_right + 1) FROM r0, r2 "
    "UNION ALL SELECT 2 * parent + 1, parent, NULL, NULL, NULL, CAST(n_left AS BIGINT), -g_left / (n_left + 1) FROM leaf "
    "UNION ALL SELECT 2 * parent + 2, parent, NULL, NULL, NULL, CAST(n_right AS BIGINT), -g_right / (n_right + 1) FROM leaf",
    "threshold gain value",
)
def boosting_first_tree(t):
    """The first boosted tree of depth two; all its features have fewer values than bins, so SQL can find its splits."""
    boosting = HistogramBoosting(inputCols=TREE_FEATURES, labelCol="conductance", rounds=1, depth=2, step=1.0, bins=MAX_BINS)
    nodes = boosting.fit(t.readings_big).tree_rows()
    rows = [(n["node"], n["parent"], n["feature"], n["threshold"], n["gain"], n["rows"], n["value"]) for n in nodes]
    return t.spark.createDataFrame(rows, "node int, parent int, feature string, threshold double, gain double, n bigint, value double")


@query(None)
def ensemble(t):
    rows, features = _prepared(t)
    return ml.evaluate(rows, "turbidity", features, "ensemble")[1]


@query(None)
def compare_models(t):
    return ml.compare_models(_joined(t), "turbidity", INTERACTIVE)


@query(None)
def recommend_trained(t):
    return ml.recommend(ml.compare_models(_joined(t), "turbidity", INTERACTIVE))


@query(None)
def importance(t):
    rows, features = _prepared(t)
    return ml.importance(ml.train(rows, "turbidity", features, "rf_quick"), t.spark)


@query(None)
def batch_predict(t):
    """Learned from the older rows, applied to the newer ones."""
    rows, features = _prepared(t)
    older, newer = chrono_split(rows)
    return ml.predict(ml.train(older, "turbidity", features, "rf_quick"), newer).select("record_number", "turbidity", "prediction")


@query(None)
def model_save_load(t):
    rows, features = _prepared(t)
    older, newer = chrono_split(rows)
    path = scratch_path(t.spark, "model")
    ml.save_model(ml.train(older, "turbidity", features, "rf_quick"), path)
    return ml.regression_metrics(ml.predict(ml.load_model(path), newer), "turbidity")


_FILLED = ["temperature", "do_mgl", "ph", "salinity", "conductance"]
_CUTS = ", ".join(f"quantile_cont({c}, [1e-3, 5e-1, 9.99e-1]) AS {c}_q" for c in _FILLED)
_CLEANED = ", ".join(
    f"CASE WHEN {c} IS NULL THEN {c}_q[2] WHEN {c} < {c}_q[1] THEN {c}_q[1] WHEN {c} > {c}_q[3] THEN {c}_q[3] ELSE {c} END AS {c}" for c in _FILLED
)
_NUMBERED = (
    "k AS (SELECT *, row_number() OVER (ORDER BY timestamp, record_number) <= count(*) OVER () - ceil(count(*) OVER () * 2e-1) AS older "
    "FROM readings WHERE turbidity IS NOT NULL)"
)


@query(
    f"WITH {_NUMBERED}, q AS (SELECT {_CUTS} FROM k WHERE older) SELECT record_number, {_CLEANED}, TRUE AS scored FROM k, q WHERE NOT older",
    " ".join(_FILLED),
)
def batch_predict_filled(t):
    """Caps and medians of the older rows are saved with the model; loaded again it scores newer rows, gaps and all."""
    rows, features = ml.filled_features(t.readings.drop("chlorophyll"))
    older, newer = chrono_split(written(ml.dealt(rows, ORDER), "features"))
    path = scratch_path(t.spark, "model")
    ml.save_model(ml.train(older, "turbidity", features, "gbt_quick", clean=True, rounds=8), path)
    scored = ml.predict(ml.load_model(path), newer, cleaned=True)
    return scored.select("record_number", *_FILLED, F.col("prediction").isNotNull().alias("scored"))


@query(
    f"WITH {_NUMBERED}, f AS (SELECT older FROM k WHERE ph IS NOT NULL AND conductance IS NOT NULL AND do_mgl IS NOT NULL), "
    "n AS (SELECT count(*) AS n FROM f) SELECT CAST(n - ceil(n * 2e-1) AS BIGINT) AS train_rows, CAST(ceil(n * 2e-1) AS BIGINT) AS test_rows, "
    "CAST(ceil(n * 2e-1) AS BIGINT) AS scored_rows, TRUE AS mean_of_members, TRUE AS metrics_match, TRUE AS importance_is_one FROM n"
)
def model_facts(t):
    """What holds for any trained model: rows of each part, an ensemble's mean, metrics from predictions, importance."""
    rows = written(t.readings.select("timestamp", "record_number", *FEATURES, "turbidity").na.drop(), "features")
    older, newer = chrono_split(rows)
    members = {"rf": {"trees": 5, "depth": 4, "min_rows": 2}, "gbt": {"rounds": 4, "depth": 3}}
    model, metrics = ml.evaluate(rows, "turbidity", FEATURES, "ensemble", members=members)
    each = model.transform(newer).select("record_number", ((F.col("prediction_0") + F.col("prediction_1")) / 2).alias("mean"))
    scored = ml.predict(model, newer).join(each, "record_number")
    error = F.col("turbidity") - F.col("prediction")
    facts = scored.agg(
        F.count("prediction").alias("scored_rows"), F.every(F.abs(F.col("prediction") - F.col("mean")) < 1e-9).alias("mean_of_members"),
        F.sqrt(F.avg(error * error)).alias("again"),
    )
    total = ml.importance(model, t.spark).agg(F.sum("importance").alias("total"))
    return facts.crossJoin(metrics).crossJoin(total).select(
        "train_rows", "test_rows", "scored_rows", "mean_of_members", (F.abs(F.col("again") - F.col("rmse")) < 1e-9).alias("metrics_match"),
        (F.abs(F.col("total") - 1) < 1e-9).alias("importance_is_one"),
    )


# Fixed predictions: the salinity column stands in for a model of turbidity.
@query(
    "SELECT sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(turbidity) * count(*)) AS r2, avg(abs(e)) AS mae, count(*) AS test_rows FROM "
    "(SELECT turbidity, turbidity - salinity AS e FROM readings WHERE turbidity IS NOT NULL AND salinity IS NOT NULL) x",
    "rmse r2 mae",
)
def metrics(t):
    return ml.regression_metrics(t.readings, "turbidity", "salinity")


_SITE_SCORES = (
    "SELECT site AS model, sqrt(avg(e * e)) AS rmse, 1 - avg(e * e) / var_pop(turbidity) AS r2 FROM "
    "(SELECT site, turbidity, turbidity - salinity AS e FROM readings WHERE turbidity IS NOT NULL AND salinity IS NOT NULL) x GROUP BY site"
)


def _site_scores(t):
    e = F.col("turbidity") - F.col("salinity")
    return (
        t.readings.na.drop(subset=["turbidity", "salinity"])
        .groupBy(F.col("site").alias("model"))
        .agg(F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.avg(e * e) / F.var_pop("turbidity")).alias("r2"))
        .withColumn("status", F.lit("ok"))
    )


@query(
    f"SELECT arg_max(model, r2) AS best_r2_model, max(r2) AS best_r2, arg_min(model, rmse) AS best_rmse_model, min(rmse) AS best_rmse FROM ({_SITE_SCORES}) s",
    "best_r2 best_rmse",
)
def recommend_model(t):
    return ml.recommend(_site_scores(t))


@query(
    "SELECT feature, importance, importance * 1e2 / sum(importance) OVER () AS pct, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, "
    "sum(importance * 1e2 / total) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS running_pct FROM "
    "(SELECT *, sum(importance) OVER () AS total FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, var_samp({c}) AS importance FROM readings" for c in PARAMS
    ) + ") v) w",
    "importance pct running_pct",
)
def rank_importance(t):
    from envspark.operators.aggregate import long_report

    variances = long_report(t.readings, PARAMS, {"importance": F.var_samp}, key="feature")
    return ml.rank_importance(variances)
