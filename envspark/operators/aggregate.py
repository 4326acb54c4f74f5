"""Reports: one wide aggregate per report, reshaped to rows afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..defaults import CLASSES, HEALTH_RULES, ORDER, TARGETS
from ..functions import calendar as cal
from ..functions.numeric import (
    count_if,
    percent,
    population_to_sample_kurtosis,
    population_to_sample_skewness,
    ratio,
)
from ..functions.quality import level
from ..functions.text import component_name
from ..sources.catalog import numeric_columns
from .align import complete_weekdays
from .clean import last_days
from .quantiles import exact_quantiles, first_rows
from .scale import last_n, one_row, order_key, recency, report_rows


def _rows() -> Column:
    return F.count(F.lit(1))


def long_report(
    df: DataFrame, columns: Sequence[str], measures: Mapping[str, callable], key: str = "parameter"
) -> DataFrame:
    """One row per column with the same measures, from a single aggregate over ``df``.

    ``measures`` maps a name to a function from column to aggregate.
    """
    structs = [
        F.struct(F.lit(c).alias(key), *[make(F.col(c)).alias(name) for name, make in measures.items()])
        for c in columns
    ]
    return report_rows(df, structs)


def with_quantiles(
    report: DataFrame, df: DataFrame, columns: Sequence[str], names: Mapping[str, float], key: str = "parameter"
) -> DataFrame:
    """Adds exact quantiles to a per-column report; one row per column on both sides."""
    values = exact_quantiles(df, columns, list(names.values()))
    rows = [(c, *values[c]) for c in columns]
    schema = f"{key} string, " + ", ".join(f"{n} double" for n in names)
    return report.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), key)


# ---------------------------------------------------------------- whole-table summaries


def kpis(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Headline figures: counts, averages, newest index and its change against the 7th newest."""
    newest = last_n(df.select(*order, "wqi"), 7, order).select("wqi", recency(order).alias("rank"))
    ends = one_row(
        newest.agg(
            F.max(F.when(F.col("rank") == 1, F.col("wqi"))).alias("current"),
            F.max(F.when(F.col("rank") == 7, F.col("wqi"))).alias("seventh"),
            _rows().alias("n"),
        )
    )
    averages = {c: F.avg(c) for c in ("wqi", "ph", "turbidity", "rainfall") if c in df.columns}
    total = df.agg(
        _rows().alias("records"),
        *[a.alias(f"avg_{c}") for c, a in averages.items()],
        (_rows() / (cal.whole_days(F.min("timestamp"), F.max("timestamp")) + 1)).alias("records_per_day"),
    )
    # The change needs more than seven rows; otherwise the newest value is compared with itself.
    previous = F.when(F.col("records") > 7, F.col("_e.seventh")).otherwise(F.col("_e.current"))
    change = F.when(previous == 0, 0.0).otherwise(percent(F.col("_e.current") - previous, previous))
    return total.withColumn("_e", ends).select(
        *total.columns, F.col("_e.current").alias("current_wqi"), change.alias("change_pct")
    )


def class_distribution(df: DataFrame, classes: Sequence[str] = CLASSES, column: str = "wqi_class") -> DataFrame:
    """Rows and share of all rows per class; a class without rows shows 0."""
    counts = df.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias(column), count_if(F.col(column) == c).alias("rows"), _rows().alias("_n"))
                for c in classes
            ]
        ).alias("_rows")
    )
    return counts.select(F.inline_outer("_rows")).select(
        column, "rows", F.coalesce(percent(F.col("rows"), F.col("_n")), F.lit(0.0)).alias("pct")
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, median, std, min, quartiles and max per column."""
    report = long_report(
        df, columns, {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    )
    return with_quantiles(report, df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})


def cv_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summary with the coefficient of variation in percent."""
    return describe(df, columns).withColumn("cv_pct", percent(F.col("std"), F.col("mean")))


def index_variability(df: DataFrame, column: str = "wqi") -> DataFrame:
    mean = F.avg(column)
    return df.agg(F.when(mean == 0, 0.0).otherwise(percent(F.stddev_samp(column), mean)).alias("variability_pct"))


def shape_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summary with bias-corrected skewness and excess kurtosis, and the range."""
    report = long_report(
        df,
        columns,
        {
            "n": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": F.min,
            "max": F.max,
            "range": lambda c: F.max(c) - F.min(c),
            "skewness": lambda c: population_to_sample_skewness(F.skewness(c), F.count(c)),
            "kurtosis": lambda c: population_to_sample_kurtosis(F.kurtosis(c), F.count(c)),
        },
    )
    return with_quantiles(report, df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})


def null_report(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Type, non-null and null counts per column, and null share in percent (2 places)."""
    types = dict(df.dtypes)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("data_type"),
            F.count(c).alias("non_null"),
            (_rows() - F.count(c)).alias("nulls"),
            F.bround(percent(_rows() - F.count(c), _rows()), 2).alias("null_pct"),
        )
        for c in df.columns
    ]
    report = report_rows(df, structs)
    return report.where("nulls > 0") if only_missing else report


def null_totals(df: DataFrame) -> DataFrame:
    """Null cells, their share of all cells and the completeness share."""
    width = len(df.columns)
    filled = sum((F.count(c) for c in df.columns), F.lit(0))
    cells = _rows() * width
    return df.agg(
        (cells - filled).alias("null_cells"),
        percent(cells - filled, cells).alias("null_pct"),
        (1 - ratio((cells - filled).cast("double"), cells)).alias("completeness"),
    )


def null_matrix(df: DataFrame, n: int = 500, order: Sequence[str] = ORDER) -> DataFrame:
    """0/1 null indicator of every column for the first ``n`` rows by ``order``."""
    first = df.orderBy(*order).limit(n)
    values = [c for c in df.columns if c not in order]
    return first.select(order[-1], *[F.col(c).isNull().cast("int").alias(c) for c in values])


# ---------------------------------------------------------------- calendar profiles


def daily_mean(
    df: DataFrame, columns: Sequence[str] | None = None, timestamp: str = "timestamp", site: str | None = None
) -> DataFrame:
    """Mean per calendar day; days without readings appear with NULLs.

    The gaps are opened between consecutive known days, so the readings are
    read once. The window runs over one row per day.
    """
    columns = list(columns or numeric_columns(df))
    sites = [site] if site else []
    daily = (
        df.where(F.col(timestamp).isNotNull())
        .groupBy(*sites, cal.day(F.col(timestamp)).alias("day"))
        .agg(*[F.avg(c).alias(c) for c in columns])
    )
    return open_gaps(daily, columns, sites)


def open_gaps(daily: DataFrame, columns: Sequence[str], sites: Sequence[str]) -> DataFrame:
    """Daily rows with the days between them, which have nulls."""
    following = F.lead("day").over(Window.partitionBy(*sites).orderBy("day"))
    until = F.coalesce(F.date_sub(following, 1), F.col("day"))
    spread = daily.withColumn("_until", until).withColumn("_day", F.explode(F.sequence("day", "_until")))
    return spread.select(
        *sites,
        F.col("_day").alias("day"),
        *[F.when(F.col("_day") == F.col("day"), F.col(c)).alias(c) for c in columns],
    )


def hourly_mean(df: DataFrame, column: str, timestamp: str = "timestamp") -> DataFrame:
    return df.groupBy(F.hour(timestamp).alias("hour")).agg(F.avg(column).alias("mean"))


def weekday_mean(df: DataFrame, column: str, timestamp: str = "timestamp") -> DataFrame:
    """Mean per weekday, all seven days from Monday."""
    means = df.groupBy(cal.weekday_number(F.col(timestamp)).alias("day_num")).agg(F.avg(column).alias("mean"))
    return complete_weekdays(means).orderBy("day_num")


def monthly_mean_std(df: DataFrame, column: str, timestamp: str = "timestamp") -> DataFrame:
    grouped = df.groupBy(F.month(timestamp).alias("month")).agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")
    )
    return grouped.select("month", cal.month_label(F.col("month")).alias("month_name"), "mean", "std")


def weekday_hour_pivot(df: DataFrame, column: str, timestamp: str = "timestamp") -> DataFrame:
    """Mean per weekday (rows) and hour (24 columns)."""
    keyed = df.select(
        cal.weekday_number(F.col(timestamp)).alias("day_num"), F.hour(timestamp).alias("hour"), F.col(column)
    )
    hours = [F.avg(F.when(F.col("hour") == h, F.col(column))).alias(f"h{h:02d}") for h in range(24)]
    return complete_weekdays(keyed.groupBy("day_num").agg(*hours)).orderBy("day_num")


# ---------------------------------------------------------------- completeness and coverage


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null share per parameter and its category."""
    report = long_report(df, columns, {"filled": F.count, "pct": lambda c: percent(F.count(c), _rows())})
    category = F.when(F.col("pct") >= 95, "Excellent").when(F.col("pct") >= 80, "Good").when(
        F.col("pct") >= 60, "Fair"
    ).otherwise("Poor")
    return report.withColumn("category", category)


def completeness_rollup(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled cells per category and parameter with subtotals (level 0 detail, 1 category, 3 all)."""
    return (
        completeness(df, columns)
        .rollup("category", "parameter")
        .agg(F.sum("filled").alias("filled"), F.avg("pct").alias("pct"), F.grouping_id().alias("level"))
    )


def season_class(df: DataFrame, column: str = "wqi_class", autumn: str = "Autumn") -> DataFrame:
    season = cal.season(F.month("timestamp"), autumn)
    return df.groupBy(season.alias("season"), column).agg(_rows().alias("rows"))


def active_sites(df: DataFrame, site: str, days: int = 7, approximate: bool = False) -> DataFrame:
    """Distinct sites, and distinct sites with a reading in the newest ``days`` days."""
    newest = df.agg((F.max("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")).alias("cut"))
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    # One row per site first, so the distinct count sees each site once.
    per_site = df.groupBy(site).agg(F.max("timestamp").alias("newest")).withColumn("_cut", newest.scalar())
    return per_site.agg(
        distinct(site).alias("sites"),
        distinct(F.when(F.col("newest") >= F.col("_cut"), F.col(site))).alias("active_sites"),
    )


def active_sites_by_day(df: DataFrame, site: str, days: int = 7, timestamp: str = "timestamp") -> DataFrame:
    """``day, active_sites``: distinct sites with a reading in the ``days`` days up to each day, gaps included.

    A site is active from a day with readings on until ``days`` later. Its
    stretches begin and end at most once a day, so they are added up as steps:
    no window or set holds the sites of a day, however many they are.
    """
    day = cal.day(F.col(timestamp)).alias("day")
    seen = df.where(F.col(timestamp).isNotNull() & F.col(site).isNotNull()).select(F.col(site).alias("_site"), day).distinct()
    by_site = Window.partitionBy("_site").orderBy("day")
    until = F.date_add("day", days)
    before, after = F.lag(until).over(by_site), F.lead("day").over(by_site)
    marked = seen.select("day", until.alias("_end"), F.coalesce(before >= F.col("day"), F.lit(False)).alias("_goes_on"), F.coalesce(after <= until, F.lit(False)).alias("_kept"))
    steps = marked.select(
        F.explode(
            F.array(
                F.struct("day", F.when(F.col("_goes_on"), 0).otherwise(1).alias("step")),
                F.struct(F.col("_end").alias("day"), F.when(F.col("_kept"), 0).otherwise(-1).alias("step")),
            )
        ).alias("_s")
    ).select("_s.day", "_s.step")
    daily = steps.groupBy("day").agg(F.sum("step").alias("step"))
    # One row a day from here on.
    total = F.sum("step").over(Window.orderBy("day"))
    last = df.agg(F.max(cal.day(F.col(timestamp))).alias("last"))
    running = daily.select("day", total.alias("active_sites"))
    spread = running.withColumn("_until", F.date_sub(F.coalesce(F.lead("day").over(Window.orderBy("day")), F.date_add("day", 1)), 1))
    return spread.select(F.explode(F.sequence("day", "_until")).alias("day"), "active_sites").where(F.col("day") <= last.scalar())


def coverage_summary(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Whole days spanned, records, samples per day, first and newest timestamp."""
    days = cal.whole_days(F.min(timestamp), F.max(timestamp)).cast("bigint")
    return df.agg(
        days.alias("days"),
        _rows().alias("records"),
        (_rows() / F.greatest(days, F.lit(1))).alias("samples_per_day"),
        F.min(timestamp).alias("first"),
        F.max(timestamp).alias("latest"),
    )


def weather_summary(weather: DataFrame) -> DataFrame:
    """Total, mean and maximum rainfall, wet rows and their share, days spanned."""
    wet = count_if(F.col("rainfall") > 0)
    return weather.agg(
        F.sum("rainfall").alias("total"),
        F.avg("rainfall").alias("mean"),
        F.max("rainfall").alias("max"),
        wet.alias("wet_days"),
        percent(wet, _rows()).alias("wet_pct"),
        (F.datediff(F.max("date"), F.min("date")) + 1).cast("bigint").alias("span_days"),
    )


def weather_coverage(df: DataFrame, threshold: float = 0.05, empty: float = 0.01) -> DataFrame:
    """Non-null share of every weather column, and one status for all of them."""
    columns = [c for c in df.columns if c.lower().startswith("rain")]
    shares = [ratio(F.count(c).cast("double"), _rows()) for c in columns]
    worst, best = (F.least, F.greatest) if len(shares) > 1 else (lambda x: x, lambda x: x)
    status = F.when(best(*shares) <= empty, "empty").when(worst(*shares) <= threshold, "low").otherwise("ok")
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), s.alias("coverage"), status.alias("status"))
            for c, s in zip(columns, shares)
        ]
    )
    return df.agg(rows.alias("_rows")).select(F.inline_outer("_rows"))


# ---------------------------------------------------------------- health and recent status


def health_score(df: DataFrame, compliance_at: float = 60.0, higher_is_better: bool = True) -> DataFrame:
    """Overall score, compliance share and stability of the index."""
    excellent = percent(count_if(F.col("wqi_class") == "Excellent"), _rows())
    good = percent(count_if(F.col("wqi_class") == "Good"), _rows())
    passes = F.col("wqi") >= compliance_at if higher_is_better else F.col("wqi") <= compliance_at
    std = F.stddev_samp("wqi")
    return df.agg(
        (excellent + good * 0.8).alias("health_score"),
        percent(count_if(passes), _rows()).alias("compliance_pct"),
        F.greatest(F.lit(0.0), 100 - std * 2).alias("stability"),
        std.alias("wqi_std"),
    )


def parameter_health(df: DataFrame, rules: Sequence[tuple] = HEALTH_RULES) -> DataFrame:
    """Mean, share of all rows within the limit and status per parameter."""
    structs = []
    for column, test, high, mid, low, upper, lower in rules:
        if column not in df.columns:
            continue
        share = percent(count_if(F.expr(test.format(c=column))), _rows())
        status = F.when(share >= upper, high).when(share >= lower, mid).otherwise(low)
        structs.append(
            F.struct(
                F.lit(column).alias("parameter"),
                F.avg(column).alias("mean"),
                share.alias("within_pct"),
                status.alias("status"),
            )
        )
    return report_rows(df, structs)


def latest_values(df: DataFrame, columns: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """The newest row's values, one row (a max over the order key, no sort)."""
    newest = F.max_by(F.struct(*columns), order_key(order))
    return df.agg(newest.alias("_v")).select("_v.*")


def recent_status(df: DataFrame, days: int = 7, order: Sequence[str] = ORDER) -> DataFrame:
    """Index level, range and class shares over the newest ``days`` days."""
    current = F.max_by("wqi", order_key(order))
    share = lambda *names: percent(count_if(F.col("wqi_class").isin(*names)), _rows())
    return last_days(df, days).agg(
        current.alias("current"),
        F.avg("wqi").alias("mean"),
        F.min("wqi").alias("min"),
        F.max("wqi").alias("max"),
        (F.max("wqi") - F.min("wqi")).alias("range"),
        (current - F.avg("wqi")).alias("current_minus_mean"),
        share("Excellent").alias("excellent_pct"),
        share("Good").alias("good_pct"),
        share("Poor", "Very Poor").alias("alert_pct"),
    )


def recent_alerts(df: DataFrame, days: int = 7) -> DataFrame:
    """Alert counts of the newest ``days`` days; the turbidity limit is the whole table's p95."""
    (high,) = exact_quantiles(df, ["turbidity"], (0.95,))["turbidity"]
    alerts = last_days(df, days).agg(
        count_if(F.col("wqi_class") == "Very Poor").alias("very_poor"),
        count_if(F.col("turbidity") > F.lit(high)).alias("high_turbidity"),
        count_if((F.col("ph") < 6.5) | (F.col("ph") > 8.5)).alias("ph_out"),
    )
    return alerts.withColumn("total", F.expr("very_poor + high_turbidity + ph_out"))


def recent_stats(df: DataFrame, columns: Sequence[str], days: int = 7) -> DataFrame:
    return long_report(
        last_days(df, days), columns, {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    )


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, std, min and max per feature, 3 places."""
    third = lambda f: lambda c: F.bround(f(c), 3)
    return long_report(
        df, columns, {"mean": third(F.avg), "std": third(F.stddev_samp), "min": third(F.min), "max": third(F.max)}
    )


def target_gauge(df: DataFrame, targets: Sequence[tuple] = TARGETS, days: int = 7) -> DataFrame:
    """Recent mean against its target, with the band it falls in."""
    structs = []
    for column, target, good_low, good_high, ok_low, ok_high in targets:
        mean = F.avg(column)
        band = (
            F.when(mean.between(good_low, good_high), "good")
            .when(mean.between(ok_low, ok_high), "acceptable")
            .when(mean.isNotNull(), "outside")
        )
        structs.append(
            F.struct(
                F.lit(column).alias("parameter"),
                mean.alias("mean"),
                F.lit(target).alias("target"),
                (mean - target).alias("delta"),
                band.alias("band"),
            )
        )
    return report_rows(last_days(df, days), structs)


def index_gauge(df: DataFrame, order: Sequence[str] = ORDER, zones: Sequence[float] = (40.0, 60.0, 80.0)) -> DataFrame:
    """Newest index against the overall mean, and its zone."""
    current = F.max_by("wqi", order_key(order))
    zone = level(current, [(z, n) for z, n in zip(zones, ("below 40", "40-60", "60-80"))], "80 and above")
    return df.agg(
        current.alias("current"),
        F.avg("wqi").alias("mean"),
        (current - F.avg("wqi")).alias("delta"),
        zone.alias("zone"),
    )


def latest_profile(
    df: DataFrame, columns: Sequence[str], order: Sequence[str] = ORDER, target: float = 85.0
) -> DataFrame:
    """Newest value of each parameter scaled to 0-100 over its range; 50 where there is no range."""
    def scaled(c):
        span = F.max(c) - F.min(c)
        newest = F.max_by(c, order_key(order))
        return F.when(span > 0, percent(newest - F.min(c), span)).otherwise(50.0)

    return long_report(df, columns, {"current": scaled, "target": lambda c: F.max(F.lit(target))})


def half_flow(df: DataFrame, classes: Sequence[str] = CLASSES, order: Sequence[str] = ORDER) -> DataFrame:
    """Flow between the classes of the first and the second half of the series.

    The halves are split at the key of the middle row, found by rank search.
    """
    n = df.count()
    first = first_rows(df, n // 2, order)
    tagged = df.select("wqi_class", first.alias("early"))
    counts = tagged.agg(
        F.array(*[count_if((F.col("wqi_class") == c) & F.col("early")) for c in classes]).alias("a"),
        F.array(*[count_if((F.col("wqi_class") == c) & ~F.col("early")) for c in classes]).alias("b"),
    )
    links = [
        F.struct(
            F.lit(x).alias("from_class"),
            F.lit(y).alias("to_class"),
            F.expr(f"least(a[{i}], b[{j}]) div 3").alias("flow"),
        )
        for i, x in enumerate(classes)
        for j, y in enumerate(classes)
    ]
    return counts.select(F.inline(F.array(*links))).where("flow > 0")


def contribution_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_contrib")]


def latest_contributions(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Each component's contribution in the newest row, and their total."""
    columns = contribution_columns(df)
    newest = latest_values(df, columns, order)
    rows = newest.unpivot([], columns, "component", "value")
    return (
        rows.withColumn("component", component_name(F.col("component")))
        .rollup("component")
        .agg(F.sum("value").alias("value"))
        .withColumn("component", F.coalesce("component", F.lit("Total")))
    )


def contribution_series(df: DataFrame) -> DataFrame:
    """Daily mean contribution per component in long form, missing days 0."""
    columns = contribution_columns(df)
    daily = daily_mean(df, columns).fillna(0.0, subset=columns)
    return daily.unpivot(["day"], columns, "component", "value").withColumn(
        "component", component_name(F.col("component"))
    )


def feature_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Input range per feature: p5 to p95, else min to max, else median ± 1."""
    report = with_quantiles(
        long_report(df, columns, {"lo": F.min, "hi": F.max}),
        df,
        columns,
        {"p5": 0.05, "mid": 0.5, "p95": 0.95},
    )
    wide, spread = F.col("p5") < F.col("p95"), F.col("lo") < F.col("hi")
    return report.select(
        "parameter",
        F.when(wide, F.col("p5")).when(spread, F.col("lo")).otherwise(F.col("mid") - 1).alias("low"),
        F.when(wide, F.col("p95")).when(spread, F.col("hi")).otherwise(F.col("mid") + 1).alias("high"),
        F.col("mid").alias("median"),
    )


def period_means(
    df: DataFrame, column: str = "wqi", rows: Sequence[int] = (7, 30, 90), order: Sequence[str] = ORDER
) -> DataFrame:
    """Mean over the newest 7, 30, 90 rows (0 if the table is shorter) and over all rows."""
    ranked = last_n(df.select(*order, column), max(rows), order).select(column, recency(order).alias("rank"))
    recent = ranked.agg(
        *[
            F.when(_rows() >= n, F.avg(F.when(F.col("rank") <= n, F.col(column)))).otherwise(0.0).alias(f"last_{n}")
            for n in rows
        ]
    )
    overall = df.agg(F.avg(column).alias("overall"))
    return recent.withColumn("overall", overall.scalar())


def group_moments(df: DataFrame, column: str, by: str = "wqi_class") -> DataFrame:
    """Count, mean and variance of a column per group."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(by)
        .agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.var_samp(column).alias("variance"))
    )
