"""Model metric records: one small text file or row per trained model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .record_files import NAME, register

# Separator of the heading line and labels of the value lines.
HEADING_SEPARATOR = " — "
LABELS = {"rmse": "RMSE", "r2": "R²", "mae": "MAE"}


def metrics_text(row_model: Column, target: Column) -> Column:
    """The text record of one model, from columns rmse, r2, mae, train_rows, test_rows."""
    lines = [F.format_string("%s" + HEADING_SEPARATOR + "%s", row_model, target)]
    lines += [F.format_string(f"{label}: %.4f", F.col(c)) for c, label in LABELS.items()]
    lines.append(F.format_string("Train: %d | Test: %d", F.col("train_rows"), F.col("test_rows")))
    return F.concat_ws("\n", *lines)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    """Append metric rows, or replace earlier ones with ``mode="overwrite"`` (an action).

    ``fmt="text"`` writes one record ``<model>_<target>`` per row, in lower case
    with ``_`` for whatever is no letter, digit, dot or dash, which
    :func:`scan_metrics` reads again. All rows of a call are kept, also those of
    equal names; records of a name from earlier calls are replaced. A job that
    fails leaves no record. Unknown names are ``unknown``.
    """
    if fmt == "text":
        register(metrics.sparkSession)
        model, target = (F.coalesce(c, F.lit("unknown")) for c in ("model", "target"))
        name = F.regexp_replace(F.lower(F.concat_ws("_", model, target)), "[^\\p{L}\\p{N}.-]", "_")
        records = metrics.select(name.alias("name"), metrics_text(model, target).alias("value"))
        records.write.format(NAME).mode(mode).save(path)
        return
    metrics.write.mode(mode).format(fmt).save(path)


def parse_metrics(records: DataFrame, value: str = "value") -> DataFrame:
    """Metric rows from text records; records with neither RMSE nor R² are left out."""
    text = F.col(value)
    heading = F.split(F.trim(F.substring_index(text, "\n", 1)), HEADING_SEPARATOR)

    def number(label: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"(?m)^\s*{label}:\s*(\S+)", 1), F.lit("")).try_cast("double")

    rows = records.select(
        *[c for c in records.columns if c != value],
        heading[0].alias("model_type"),
        F.coalesce(F.get(heading, 1), F.lit("Unknown")).alias("target"),
        *[number(label).alias(c) for c, label in LABELS.items()],
        number("Train").cast("bigint").alias("train_rows"),
        F.nullif(F.regexp_extract(text, r"Test:\s*(\d+)", 1), F.lit("")).try_cast("bigint").alias("test_rows"),
    )
    return rows.where((F.coalesce("rmse", F.lit(0.0)) != 0) | (F.coalesce("r2", F.lit(0.0)) != 0))


def scan_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read every ``*_metrics.txt`` below ``path``, but nothing of jobs that did not finish."""
    register(spark)
    files = spark.read.format(NAME).load(path)
    return parse_metrics(files.select(F.concat("name", F.lit("_metrics")).alias("model"), "value"))
