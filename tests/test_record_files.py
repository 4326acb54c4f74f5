"""Text records with a commit: all rows back, nothing of a job that failed."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from envspark.sources import metrics, record_files

SCHEMA = "model string, target string, rmse double, r2 double, mae double, train_rows bigint, test_rows bigint"


def rows(spark, *names):
    return spark.createDataFrame([(m, t, float(i + 1), 0.5, 0.5, 8, 2) for i, (m, t) in enumerate(names)], SCHEMA)


def scanned(spark, path):
    return sorted((r.model, r.rmse) for r in metrics.scan_metrics(spark, str(path)).collect())


def shown(path):
    return sorted(p.name for p in Path(path).iterdir())


def test_rows_of_one_name_are_all_kept(spark, tmp_path):
    metrics.write_metrics(rows(spark, ("A b", "ph"), ("a_b", "ph"), ("A_B", "ph"), ("c", "ph")).repartition(3), str(tmp_path), fmt="text")
    got = scanned(spark, tmp_path)
    assert [m for m, _ in got] == ["a_b_ph-2_metrics", "a_b_ph-3_metrics", "a_b_ph_metrics", "c_ph_metrics"]
    assert sorted(r for _, r in got) == [1.0, 2.0, 3.0, 4.0]
    # A later call replaces all records of its names and leaves the others.
    metrics.write_metrics(rows(spark, ("a b", "ph")), str(tmp_path), fmt="text")
    assert scanned(spark, tmp_path) == [("a_b_ph_metrics", 1.0), ("c_ph_metrics", 4.0)]
    assert shown(tmp_path) == ["a_b_ph_metrics.txt", "c_ph_metrics.txt"]
    metrics.write_metrics(rows(spark, ("d", "ph")), str(tmp_path), fmt="text", mode="overwrite")
    assert scanned(spark, tmp_path) == [("d_ph_metrics", 1.0)]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    metrics.write_metrics(rows(spark, ("a", "ph")), str(tmp_path), fmt="text")
    record_files.register(spark)
    value = F.when(F.col("id") == 9, F.raise_error(F.lit("stop"))).otherwise(F.lit("Forest\nRMSE: 2.0\n"))
    bad = spark.range(0, 10, 1, 5).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("name"), value.cast("string").alias("value"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format(record_files.NAME).mode("overwrite").save(str(tmp_path))
    assert scanned(spark, tmp_path) == [("a_ph_metrics", 1.0)]
    assert shown(tmp_path) == ["a_ph_metrics.txt"]


def test_a_driver_lost_after_the_list_is_made_up_for(spark, tmp_path):
    """The list counts at once; readers follow it, the next writer finishes the moves."""
    metrics.write_metrics(rows(spark, ("a", "ph"), ("b", "ph")), str(tmp_path), fmt="text")
    (tmp_path / ".jobs/j/t").mkdir(parents=True)
    (tmp_path / ".jobs/j/t/0").write_text("Forest — ph\nRMSE: 7.0\n")
    (tmp_path / ".jobs/other/t").mkdir(parents=True)
    (tmp_path / ".jobs/other/t/0").write_text("Forest — ph\nRMSE: 9.0\n")  # of a job that never got so far
    job = {"job": "j", "order": 0, "files": [[".jobs/j/t/0", "a_ph_metrics.txt"]], "removed": ["b_ph_metrics.txt"]}
    (tmp_path / ".committed-j").write_text(json.dumps(job))
    assert scanned(spark, tmp_path) == [("a_ph_metrics", 7.0)]
    metrics.write_metrics(rows(spark, ("c", "ph")), str(tmp_path), fmt="text")
    assert scanned(spark, tmp_path) == [("a_ph_metrics", 7.0), ("c_ph_metrics", 1.0)]
    assert [n for n in shown(tmp_path) if not n.startswith(".")] == ["a_ph_metrics.txt", "c_ph_metrics.txt"]
    assert not (tmp_path / ".committed-j").exists() and not (tmp_path / ".jobs/j").exists()


def test_names_and_values_must_be_there(spark, tmp_path):
    record_files.register(spark)
    with pytest.raises(Exception, match="name and a value"):
        spark.createDataFrame([(None, "x")], "name string, value string").write.format(record_files.NAME).mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="columns name and value"):
        spark.range(1).write.format(record_files.NAME).mode("append").save(str(tmp_path))
    assert scanned(spark, tmp_path) == []


def test_uri_paths(spark, tmp_path):
    metrics.write_metrics(rows(spark, ("a", "ph")), tmp_path.as_uri(), fmt="text")
    assert scanned(spark, tmp_path.as_uri()) == scanned(spark, tmp_path) == [("a_ph_metrics", 1.0)]
