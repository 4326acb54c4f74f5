"""Daily state in several updates, and active sites by day."""

from datetime import date, datetime, timedelta
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from envspark.operators.aggregate import active_sites_by_day, daily_mean
from envspark.sources.daily_state import DailyState

START = datetime(2024, 1, 1)


def readings(spark):
    rows = []
    for i in range(300):
        at = START + timedelta(hours=i * 5) if i != 7 else None
        value = float("nan") if i % 31 == 0 else None if i % 13 == 0 else float(i % 17) * 1e3 + 1e6
        rows.append((at, i, None if i % 29 == 0 else f"s{i % 3}", value, None))
    days_out = {2, 11}
    rows = [r for r in rows if r[0] is None or r[0].day not in days_out]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, record_number long, site string, v double, empty double")


def shown(df):
    return sorted(((tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in df.collect()), key=str)


def test_updates_in_any_order_equal_one_run(spark, tmp_path):
    df = readings(spark)
    arrivals = [df.where("record_number < 90"), df.where("record_number >= 90 AND record_number % 2 = 0"), df.where("record_number >= 90 AND record_number % 2 = 1")]
    whole = DailyState(spark, f"{tmp_path}/whole", ["v", "empty"], site="site")
    whole.update(df, 1)
    want = shown(whole.statistics())
    clean = df.where("timestamp IS NOT NULL").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    direct = clean.groupBy(F.col("timestamp").cast("date").alias("day"), "site").agg(
        F.count(F.lit(1)).alias("rows"), F.count("v").alias("v_n"), F.avg("v").alias("v"), F.stddev_samp("v").alias("v_std")
    )
    assert want == shown(direct.select("day", "rows", "site", "v_n", "v", "v_std", F.lit(0).cast("bigint").alias("empty_n"), F.lit(None).cast("double").alias("empty"), F.lit(None).cast("double").alias("empty_std")))
    for k, order in enumerate(permutations(range(3))):
        if k not in (0, 3, 5):
            continue
        state = DailyState(spark, f"{tmp_path}/state{k}", ["v", "empty"], site="site")
        for number, i in enumerate(order):
            state.update(arrivals[i], number)
        assert shown(state.statistics()) == want
    plain = DailyState(spark, f"{tmp_path}/plain", ["v"])
    for number in range(3):
        plain.update(arrivals[number], number)
    assert shown(plain.means()) == shown(daily_mean(clean, ["v"]))


def test_a_repeated_update_counts_once(spark, tmp_path):
    df = readings(spark)
    state = DailyState(spark, f"{tmp_path}/s", ["v"])
    state.update(df.where("record_number < 150"), 1)
    # An update that failed after some of its days were written.
    state.update(df.where("record_number >= 100 AND record_number < 120"), 2)
    state.update(df.where("record_number >= 100 AND record_number < 120"), 2)
    once = DailyState(spark, f"{tmp_path}/t", ["v"])
    once.update(df.where("record_number < 150").unionAll(df.where("record_number >= 100 AND record_number < 120")), 1)
    assert shown(state.statistics()) == shown(once.statistics())
    assert state.update(df.where("record_number < 0"), 3) == [] and state.update(df.where("timestamp IS NULL"), 4) == []


def test_only_touched_days_are_read_and_written(spark, tmp_path):
    df = readings(spark)
    state = DailyState(spark, f"{tmp_path}/s", ["v"])
    state.update(df, 1)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    touched = state.update(df.where("timestamp >= '2024-01-20' AND timestamp < '2024-01-22'"), 2)
    assert touched == [date(2024, 1, 20), date(2024, 1, 21)]
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    gone = {p.parent.name for p in files.keys() - after.keys()}
    assert gone == {"day=2024-01-20", "day=2024-01-21"} and all(after[p] == t for p, t in files.items() if p in after)
    read = state.touched(touched)
    read.collect()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    metrics = read._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert metrics.apply("numPartitions").value() == 2


def test_following_a_stream(spark, tmp_path):
    df = readings(spark).drop("empty")
    for k in range(3):
        df.where(F.col("record_number") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    state = DailyState(spark, f"{tmp_path}/s", ["v"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state.follow(stream, f"{tmp_path}/check").awaitTermination(120)
    once = DailyState(spark, f"{tmp_path}/t", ["v"])
    once.update(df, 1)
    assert shown(state.statistics()) == shown(once.statistics())


@pytest.mark.parametrize("days", [1, 3, 7])
def test_active_sites_by_day(spark, days):
    df = readings(spark)
    known = [(r.timestamp.date(), r.site) for r in df.collect() if r.timestamp]
    first, last = min(d for d, s in known if s), max(d for d, _ in known)
    want = {}
    for k in range((last - first).days + 1):
        at = first + timedelta(days=k)
        want[at] = len({s for d, s in known if s and at - timedelta(days=days) < d <= at})
    assert {r.day: r.active_sites for r in active_sites_by_day(df, "site", days).collect()} == want
    assert active_sites_by_day(df.where("record_number < 0"), "site").count() == 0


def test_active_sites_of_many_sites(spark):
    df = spark.range(200_000).select((F.col("id") % 100_000).cast("string").alias("site"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 40 as int))").alias("timestamp"))
    got = active_sites_by_day(df, "site", 7).agg(F.max("active_sites"), F.count(F.lit(1))).first()
    assert tuple(got) == (7 * 2500, 40)
