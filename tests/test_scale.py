"""Order, blocks, carries and quantiles give the same answer however the work is split."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from envspark.operators import scale, series as ops
from envspark.operators.quantiles import exact_quantiles, first_rows, kth_value


def column(df, name, by="record_number"):
    return [r[name] for r in df.orderBy(by).select(name).collect()]


def shuffled(df, n=7):
    return df.repartition(n, F.rand(seed=3))


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_position_is_gapless_along_the_order(series, partitions):
    df = shuffled(series([float(i) for i in range(500)]))
    got = scale.with_position(df, partitions=partitions)
    assert column(got, "position") == list(range(500))


def test_position_with_equal_timestamps(spark):
    # A third of all rows share one timestamp; the record number still orders them.
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=0 if i % 3 else i), i) for i in range(300)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, record_number bigint")
    got = scale.with_position(shuffled(df)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(300))
    assert [(r.timestamp, r.record_number) for r in got] == sorted(rows)


@pytest.mark.parametrize("block_rows", [8, 33, 10_000])
@pytest.mark.parametrize("rows,center", [(7, True), (4, True), (5, False)])
def test_rolling_equals_pandas_in_any_blocking(series, rows, center, block_rows):
    rng = random.Random(1)
    values = [None if rng.random() < 0.05 else rng.random() for _ in range(400)]
    got = ops.rolling(shuffled(series(values)), "v", rows=rows, center=center, stats=("mean", "std"), block_rows=block_rows)
    frame = pd.Series(values, dtype=float).rolling(rows, center=center)
    for name, want in (("rolling_mean", frame.mean()), ("rolling_std", frame.std())):
        np.testing.assert_allclose(np.array(column(got, name), dtype=float), want.to_numpy(), atol=1e-12)


def test_even_centred_window_by_hand(series):
    values = [1.0, 2, 4, 8, 16, 32, 64]
    for rows, want in ((4, [None, None, 15, 30, 60, 120, None]), (3, [None, 7, 14, 28, 56, 112, None])):
        got = column(ops.rolling(series(values), "v", rows=rows, center=True), "rolling_mean")
        assert [g and round(g * rows, 9) for g in got] == want


def test_rolling_per_site_does_not_mix_sites(series):
    sites = ["a" if i % 3 else "b" for i in range(60)]
    values = [float(i) for i in range(60)]
    got = ops.rolling(series(values, site=sites), "v", rows=3, site="site", block_rows=7)
    want = pd.DataFrame({"s": sites, "v": values}).groupby("s")["v"].rolling(3).mean().droplevel(0).sort_index()
    np.testing.assert_allclose(np.array(column(got, "rolling_mean"), dtype=float), want.to_numpy())


@pytest.mark.parametrize("partitions", [1, 6, 40])
def test_carry_crosses_empty_blocks(series, partitions):
    values = [None] * 5 + [1.0] + [None] * 40 + [2.0, 3.0] + [None] * 20
    got = scale.carried(shuffled(series(values)), ["v"], partitions=partitions)
    s = pd.Series(values, dtype=float)
    np.testing.assert_array_equal(np.array(column(got, "v_prev"), dtype=float), s.ffill().to_numpy())
    np.testing.assert_array_equal(np.array(column(got, "v_next"), dtype=float), s.bfill().to_numpy())


@pytest.mark.parametrize("partitions", [1, 16])
def test_carry_per_site(series, partitions):
    sites = ["a", "b", "b", "c"] * 15
    values = [None if i % 4 in (0, 1) and i < 40 else float(i) for i in range(60)]
    got = scale.carried(series(values, site=sites), ["v"], site="site", partitions=partitions)
    frame = pd.DataFrame({"s": sites, "v": pd.Series(values, dtype=float)})
    np.testing.assert_array_equal(np.array(column(got, "v_prev"), dtype=float), frame.groupby("s")["v"].ffill().to_numpy())
    np.testing.assert_array_equal(np.array(column(got, "v_next"), dtype=float), frame.groupby("s")["v"].bfill().to_numpy())


def test_lags_and_sequences_across_blocks(series):
    values = [float(i) for i in range(30)]
    lagged = ops.lag_features(series(values), "v", 2, block_rows=4)
    assert column(lagged, "v_lag_2") == [None, None] + values[:-2]
    made = ops.sequences(series(values), "v", 5, block_rows=6).orderBy("record_number").collect()
    assert [r.sequence for r in made] == [values[i : i + 5] for i in range(25)]
    assert [r.next_value for r in made] == values[5:]


def test_running_totals_cross_partitions(spark):
    rows = [(c, float(v), v + 1) for c in (0, 1) for v in range(50)]
    df = spark.createDataFrame(rows, "c int, v double, n bigint")
    for partitions in (1, 5, 40):
        got = scale.running_totals(df, "c", "v", ["n"], partitions).orderBy("c", "v").collect()
        want = [sum(range(1, v + 1)) for _ in (0, 1) for v in range(50)]
        assert [r.n_before for r in got] == want


# ---------------------------------------------------------------- quantiles

CASES = {
    "spread": [random.Random(2).gauss(0, 1) for _ in range(3000)],
    "hot value": [0.0] * 1000 + [random.Random(3).random() for _ in range(2000)],
    "two values": [1.0] * 1500 + [2.0] * 1500,
    "far outliers": [1e300, -1e300] + [float(i) for i in range(2000)],
    "constant": [4.0] * 100,
    "one": [3.5],
    "two": [1.0, 2.0],
    "with nulls": [None if i % 3 == 0 else float(i % 77) for i in range(2000)],
}


@pytest.mark.parametrize("limit", [5, 60, 1_000_000])
@pytest.mark.parametrize("case", CASES)
def test_quantiles_are_exact_in_any_number_of_rounds(spark, case, limit):
    probabilities = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.95, 0.999, 1.0]
    values = CASES[case]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = exact_quantiles(df, ["v"], probabilities, limit)["v"]
    want = pd.Series(values, dtype=float).dropna().quantile(probabilities).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


def test_quantiles_of_several_columns_and_of_none(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 6), (4.0, None)], "a double, b int").withColumn("c", F.lit(None).cast("double"))
    got = exact_quantiles(df, ["a", "b", "c"], (0.5, 0.25))
    assert got == {"a": [2.0, 1.5], "b": [5.5, 5.25], "c": [None, None]}


@pytest.mark.parametrize("limit", [3, 100_000])
def test_kth_value_with_ties(spark, limit):
    values = sorted([7] * 400 + list(range(0, 2000, 3)) + [2**52 + i for i in range(50)])
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(4)
    for k in (0, 1, 5, 200, 402, 403, 900, len(values) - 1):
        value, below = kth_value(df, F.col("v"), k, limit)
        assert value == values[k]
        assert below == sum(v < values[k] for v in values)


@pytest.mark.parametrize("limit", [4, 100_000])
def test_first_rows_split_equal_timestamps(spark, limit):
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i // 40), (i * 7919) % 1000) for i in range(200)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, record_number bigint")
    for n in (0, 1, 40, 77, 199, 200):
        got = df.where(first_rows(df, n, limit=limit)).collect()
        assert sorted(tuple(r) for r in got) == sorted(rows)[:n]


def test_no_row_is_lost_without_site_timestamp_or_number(spark):
    from envspark.operators.clean import impute
    from envspark.operators.quantiles import exact_quantiles
    from envspark.operators.series import chrono_split
    from pyspark.sql import functions as F

    rows = spark.range(60).select(
        F.when(F.col("id") % 6 > 0, F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz")).alias("timestamp"),
        F.col("id").alias("record_number"),
        F.when(F.col("id") % 3 > 0, F.lit("a")).alias("site"),
        F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("v"),
    )
    assert impute(rows, ["v"], "ffill_bfill", site="site").count() == 60
    for test, newer in ((0.2, 12), (0.95, 57)):
        train, rest = chrono_split(rows, test)
        assert (train.count(), rest.count()) == (60 - newer, newer)
    odd = spark.range(60_000).select(
        F.when(F.col("id") % 5 == 0, float("nan")).when(F.col("id") % 7 == 0, float("inf")).otherwise(F.col("id").cast("double")).alias("v")
    )
    kept = sorted(i for i in range(60_000) if i % 5 and i % 7)
    assert exact_quantiles(odd, ["v"], [0.0, 1.0])["v"] == [kept[0], kept[-1]]


def test_density_of_a_constant_column_is_empty(spark):
    from envspark.operators.distribution import kde
    from pyspark.sql import functions as F

    assert kde(spark.range(50).select(F.lit(3.0).alias("v")), "v").count() == 0


def test_site_numbers_stay_as_they_are(spark):
    from envspark.plans.enrich import enrich
    from pyspark.sql import functions as F

    rows = spark.range(40).select(
        F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("timestamp"), F.col("id").alias("record_number"),
        F.when(F.col("id") > 0, F.lit(7)).alias("site"), F.col("id").cast("double").alias("ph"),
    )
    done = enrich(rows)
    assert dict(done.dtypes)["site"] == "int" and done.where("site IS NULL").count() == 1


@pytest.mark.parametrize("rows", [10_000, 200_000])
def test_quantiles_read_the_input_three_times(spark, rows, monkeypatch):
    from envspark.operators import quantiles

    df = spark.range(rows).select((F.xxhash64("id") / 1e6).alias("v"), F.pmod(F.xxhash64("id"), F.lit(9)).cast("double").alias("few"))
    passes = []
    plain_row, plain_write = quantiles._first_row, quantiles._write_brackets
    monkeypatch.setattr(quantiles, "_first_row", lambda t, c: (passes.append("row") if t is df else None, plain_row(t, c))[1])
    monkeypatch.setattr(quantiles, "_write_brackets", lambda t, g: (passes.append("write"), plain_write(t, g))[1])
    got = quantiles.exact_quantiles(df, ["v", "few"], (0.05, 0.25, 0.5), limit=50)
    want = df.agg(*[F.percentile(c, F.array(F.lit(0.05), F.lit(0.25), F.lit(0.5))) for c in ("v", "few")]).first()
    np.testing.assert_allclose([got["v"], got["few"]], list(want), rtol=1e-12)
    assert len(passes) <= 3 and "write" in passes


def test_forest_cut_from_counts():
    from envspark.operators.forest import _from_counts

    values = [0.1] * 5 + [0.4] * 3 + [0.9] * 2
    counted = [(0.9, 2), (0.1, 5), (0.4, 3)]
    for p in (0.0, 0.5, 0.55, 0.8, 0.95, 1.0):
        assert _from_counts(counted, p) == pytest.approx(float(np.quantile(values, p)))
    assert _from_counts([], 0.5) is None


def test_rolling_days_counts_days_not_rows(spark):
    from envspark.operators.series import rolling_days

    rows = [(datetime(2024, 1, d, h), s, v) for d, h, s, v in [
        (1, 1, "a", 1.0), (1, 2, "a", 3.0), (2, 1, "a", None), (3, 1, "a", 8.0), (9, 1, "a", 5.0), (1, 1, None, 7.0), (20, 1, None, None),
    ]] + [(None, "a", 100.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, site string, v double")
    got = {(r.site, r.day.day): (r.rolling_mean, r.rolling_std) for r in rolling_days(df, "v", 3, ("mean", "std"), site="site").collect()}
    root = float(np.std([1, 3, 8], ddof=1))
    want = {("a", 1): (2.0, 2**0.5), ("a", 2): (2.0, 2**0.5), ("a", 3): (4.0, root), ("a", 9): (5.0, None), (None, 1): (7.0, None), (None, 20): (None, None)}
    assert got.keys() == want.keys()
    for key, (mean, std) in want.items():
        assert got[key] == (mean if mean is None else pytest.approx(mean), std if std is None else pytest.approx(std))


def test_class_transitions_cross_blocks(spark):
    from envspark.operators.series import class_transitions

    classes = [["Good", "Poor", None][i * i % 3] for i in range(50)] + ["Poor", "Poor"]
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i // 2), i, c) for i, c in enumerate(classes)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, record_number bigint, wqi_class string").repartition(4)
    got = {(r.source, r.target): r.rows for r in class_transitions(df, block_rows=7).collect()}
    want = {}
    for pair in zip(classes, classes[1:]):
        want[pair] = want.get(pair, 0) + 1
    assert got == want
    assert class_transitions(df.limit(0)).count() == 0
