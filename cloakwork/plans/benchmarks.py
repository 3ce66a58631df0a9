"""Runs over many releases: utility and classification of each, with statuses, earlier results kept."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, utility
from ..sources.files import read_csv_typed


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its name, CSV otherwise."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv_typed(spark, path)


def run_over(spark: SparkSession, releases: dict[str, str], folder: str, step: Callable[[DataFrame, str], DataFrame], skip_existing: bool = True) -> DataFrame:
    """One row per release (name, path): status success, skipped (its result is there), missing (its file is not) or failed, and the result's path.

    A result is the table that ``step`` makes of a release, written under ``folder``; it counts as there once Spark has marked it whole.
    """
    rows = []
    for name, path in releases.items():
        target, status, error = f"{folder.rstrip('/')}/{name}", "success", None
        try:
            if skip_existing and path_exists(spark, f"{target}/_SUCCESS"):
                status = "skipped"
            elif not path_exists(spark, path):
                status = "missing"
            else:
                step(read_any(spark, path), name).withColumn("release", F.lit(name)).write.mode("overwrite").parquet(target)
        except Exception:
            status, error = "failed", traceback.format_exc()[-500:]
        rows.append((name, path, status, target if status in ("success", "skipped") else None, error))
    return spark.createDataFrame(rows, "release string, path string, status string, result string, error string")


def results(runs: DataFrame) -> DataFrame:
    """All results of runs that have one, under one another."""
    paths = [r["result"] for r in runs.filter(F.col("status").isin("success", "skipped")).select("result").collect()]
    if not paths:
        raise ValueError("no run has a result")
    return runs.sparkSession.read.option("mergeSchema", "true").parquet(*paths)


def utility_benchmark(spark: SparkSession, original: DataFrame, releases: dict[str, str], qis: Sequence[str], sensitive: Sequence[str], folder: str, skip_existing: bool = True) -> DataFrame:
    """Statuses of the utility summaries of all releases."""
    return run_over(spark, releases, folder, lambda release, _: utility.summary(original, release, qis, sensitive), skip_existing)


def average_auc(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The mean of the classes' AUC, of those that have one."""
    return metrics.groupBy(*keys).agg(F.avg("auc").alias("average_auc"))


def classification_benchmark(spark: SparkSession, releases: dict[str, str], id_col: str, features: Sequence[str], target: str, folder: str, models: Sequence[str] = ("naive_bayes",), k: int = 5, skip_existing: bool = True, **options) -> DataFrame:
    """Statuses of the class metrics (with the model's mean AUC) of all models on all releases."""

    def step(release: DataFrame, _: str) -> DataFrame:
        classes = sorted(r[0] for r in release.select(F.col(f"`{target}`").cast("string")).distinct().collect() if r[0] is not None)
        parts = []
        for m in models:
            found = classify.class_metrics(classify.out_of_fold(release, id_col, features, target, m, k, **options), classes).withColumn("model", F.lit(m))
            parts.append(found.join(F.broadcast(average_auc(found, ["model"])), "model"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return run_over(spark, releases, folder, step, skip_existing)
