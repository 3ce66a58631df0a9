"""HTML pages about releases, attacks and models, made of the engine's result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attacks, reporting
from ..operators.reporting import bars, page, section


def anonymization_page(grid: DataFrame, title: str = "Anonymization") -> str:
    """Of the results of a grid: how the runs ended, the best runs first, those without a release."""
    done = grid.filter("status = 'success'")
    parts = [section("Runs by status", grid.groupBy("status").agg(F.count("*").alias("runs")).orderBy("status")), section("Releases, best score first", done.drop("error").orderBy("score", "experiment_id"))]
    return page(title, [*parts, section("Runs without a release", grid.filter("status <> 'success'").select("experiment_id", "qis", "status", "error"))])


def linkage_page(result: DataFrame, title: str = "Record linkage") -> str:
    """Of a linkage attack's targets: the summary, the sizes of both stages, the guesses by true value, the targets at most risk."""
    sizes = reporting.histogram(result, "class_size", 10).orderBy("bin")
    first = reporting.histogram(result, "stage1_size", 10).orderBy("bin")
    risk = result.select(result.columns[0], "stage1_size", "class_size", "predicted", "probability", "true_value").orderBy("class_size", result.columns[0])
    parts = [section("Summary", attacks.linkage_summary(result)), bars("Candidates after the first stage", first, "lo", "n"), bars("Candidates in the end", sizes, "lo", "n")]
    return page(title, [*parts, section("Guesses by true value", attacks.sensitive_report(result).orderBy("true_value")), section("Targets with the fewest candidates", risk, 50)])


def membership_page(decided: DataFrame, title: str = "Membership inference") -> str:
    """Of a membership attack's targets: the rates, the best threshold, the distance of members and others, both distributions."""
    both = reporting.grouped_histogram(decided, "candidate_fraction", "is_member", 10).orderBy("bin")
    parts = [section("Rates", attacks.binary_metrics(decided)), section("Best threshold", attacks.best_threshold(decided)), section("Means of members and others", attacks.group_means(decided))]
    return page(title, [*parts, section("Kolmogorov-Smirnov", attacks.ks_two_sample(decided)), bars("Members", both, "bin", "n_in"), bars("Others", both, "bin", "n_out")])


def classification_section(metrics: DataFrame) -> str:
    """Of the class metrics of models on releases: one table, and the mean AUC of each."""
    keys = [c for c in ("release", "model") if c in metrics.columns]
    return section("Classes", metrics.orderBy(*keys, "class")) + bars("Mean AUC", metrics.groupBy(*keys).agg(F.avg("auc").alias("auc")).orderBy(*keys), keys[-1] if keys else "auc", "auc")


def classification_page(metrics: DataFrame, title: str = "Classification") -> str:
    return page(title, [classification_section(metrics)])
