"""Quality of a release: class statistics, per-attribute metrics, normalised scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import Hierarchy, with_levels


def class_statistics(release: DataFrame, qis: Sequence[str]) -> DataFrame:
    """One row about a release with a column ``suppressed``: classes, sizes, discernibility, average class size, squared errors.

    The class of suppressed rows is not an equivalence class. discernibility is the sum of squared class
    sizes plus, for each suppressed row, the number of rows; *_score columns are (max - x) / (max - min).
    """
    keys = [F.col(f"`{q}`") for q in qis]
    sized = release.groupBy(*keys, "suppressed").agg(F.count("*").alias("size"))
    own, size = ~F.col("suppressed"), F.col("size").cast("double")
    out = sized.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_rows"), F.count_if(own).alias("n_classes"), F.coalesce(F.sum(F.when(~own, F.col("size"))), F.lit(0)).alias("n_suppressed"),
        F.min(F.when(own, F.col("size"))).alias("min_class_size"), F.max(F.when(own, F.col("size"))).alias("max_class_size"), F.avg(F.when(own, size)).alias("avg_class_size"),
        F.coalesce(F.sum(F.when(own, size * size)), F.lit(0.0)).alias("squares"), F.coalesce(F.var_pop(F.when(own, size)), F.lit(0.0)).alias("size_variance"),
    )
    n = F.col("n_rows").cast("double")
    d = F.col("squares") + F.col("n_suppressed") * n
    safe = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    return out.withColumn("discernibility", d).withColumn("aecs", safe(n, F.col("n_classes"))).withColumn("discernibility_score", safe(n * n - d, n * n - n)).withColumn("aecs_score", safe(n - F.col("aecs"), n - 1)).drop("squares")


def attribute_metrics(raw: DataFrame, release: DataFrame, id_col: str, hierarchies: Sequence[Hierarchy], node: dict[str, int]) -> DataFrame:
    """One row per attribute: missings, generalization_intensity, granularity, nu_entropy, squared_error.

    Intensity is the mean of 1 - level/top (a label that is the same on lower levels counts as the lowest; suppressed
    rows 0); granularity is 1 - mean (leaves - 1) / (domain - 1) (suppressed rows 1); nu_entropy is the share of
    the largest possible -log2 P(value | label) that is kept; higher is better in all three.
    """
    names = [h.attr for h in hierarchies]
    lv = with_levels(raw.select(id_col, *[F.col(f"`{n}`") for n in names]), hierarchies).join(release.select(id_col, "suppressed"), id_col)
    parts = []
    for h in hierarchies:
        level, top = min(node.get(h.attr, 0), h.levels - 1), max(h.levels - 1, 1)
        labels = F.col(f"`levels_{h.attr}`")
        per = lv.groupBy(labels.alias("ls"), "suppressed").agg(F.count("*").alias("n"))
        lowest = F.array_position("ls", F.col("ls")[level]) - 1
        leaves = (h.table.select(F.col("levels").alias("ls")) if h.table is not None else per.select("ls")).distinct()
        sizes = leaves.groupBy(F.col("ls")[level].alias("label")).agg(F.count("*").alias("leaves"))
        domain = leaves.agg((F.count("*") - 1).cast("double").alias("span"))
        mass = per.groupBy(F.col("ls")[level].alias("label")).agg(F.sum("n").alias("mass"))
        value = per.groupBy(F.col("ls")[0].alias("leaf")).agg(F.sum("n").alias("all"))
        total = per.agg(F.sum("n").alias("total"))
        j = per.withColumn("label", F.col("ls")[level]).withColumn("leaf", F.col("ls")[0]).join(sizes, "label").join(mass, "label").join(value, "leaf").join(F.broadcast(domain)).join(F.broadcast(total))
        n, gone = F.col("n"), F.col("suppressed")
        parts.append(j.agg(
            F.lit(h.attr).alias("attribute"), (F.sum(F.when(gone, n).otherwise(0)) / F.sum(n)).alias("missings"),
            (F.sum(F.when(gone, 0.0).otherwise(n * (1 - lowest / top))) / F.sum(n)).alias("generalization_intensity"),
            (1 - F.sum(F.when(gone, n.cast("double")).otherwise(n * (F.col("leaves") - 1) / F.greatest("span", F.lit(1.0)))) / F.sum(n)).alias("granularity"),
            (1 - F.sum(F.when(gone, -n * F.log2(F.col("all") / F.col("total"))).otherwise(-n * F.log2(F.col("all") / F.col("mass")))) / F.nullif(F.sum(-n * F.log2(F.col("all") / F.col("total"))), F.lit(0.0))).alias("nu_entropy"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("nu_entropy", F.coalesce("nu_entropy", F.lit(1.0)))
