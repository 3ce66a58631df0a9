"""Classification utility: out-of-fold predictions on original and release, and one-against-all metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import range_midpoint
from ..sources.scratch import written
from .ranges import ranked, running
from .sampling import folds

ROC_POINTS = 100
#: Trees of the forest, and the most iterations of logistic regression.
TREES, ITERATIONS = 500, 2000


def split_columns(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) by the schema."""
    numeric = [f.name for f in df.schema if f.name in features and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    return numeric, [c for c in features if c not in numeric]


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Numbers by midpoints, texts with null as ``nan``: the same for original and generalized values."""
    return df.withColumns({f"x_{c}": range_midpoint(F.col(f"`{c}`").cast("string")) for c in numeric} | {f"c_{c}": F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in categorical})


def feature_stages(numeric: Sequence[str], categorical: Sequence[str], how: str, bounds: dict[str, tuple[float, float]] | None = None, bins: int = 10) -> list:
    """Pipeline stages that make ``features``: mean imputation; ``scaled``, ``plain`` or ``binned`` numbers; one-hot texts (unseen: all zero)."""
    out, parts = [], []
    if numeric:
        out.append(Imputer(inputCols=[f"x_{c}" for c in numeric], outputCols=[f"i_{c}" for c in numeric], strategy="mean"))
    if how == "binned":
        for c in numeric:
            lo, hi = (bounds or {}).get(c, (0.0, 1.0))
            cuts = [lo + (hi - lo) * i / bins for i in range(1, bins)] if hi > lo else [lo]
            out += [Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=f"i_{c}", outputCol=f"b_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"b_{c}", outputCol=f"o_{c}", dropLast=False, handleInvalid="keep")]
            parts.append(f"o_{c}")
    elif numeric:
        out.append(VectorAssembler(inputCols=[f"i_{c}" for c in numeric], outputCol="numbers", handleInvalid="keep"))
        if how == "scaled":
            out.append(StandardScaler(inputCol="numbers", outputCol="numbers_scaled", withMean=True, withStd=True))
        parts.append("numbers_scaled" if how == "scaled" else "numbers")
    for c in categorical:
        out += [StringIndexer(inputCol=f"c_{c}", outputCol=f"n_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol=f"n_{c}", outputCol=f"h_{c}", dropLast=True)]
        parts.append(f"h_{c}")
    return [*out, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def models(trees: int = TREES, iterations: int = ITERATIONS) -> dict[str, tuple[str, Callable]]:
    """name: (how numbers are prepared, a factory of (number of training rows))."""
    return {
        "logistic_regression": ("scaled", lambda n: LogisticRegression(labelCol="label", elasticNetParam=0.5, regParam=1.0 / (1e5 * max(n, 1)), standardization=False, maxIter=iterations)),
        "naive_bayes": ("binned", lambda n: NaiveBayes(labelCol="label", modelType="multinomial", smoothing=1.0)),
        "bernoulli_naive_bayes": ("binned", lambda n: NaiveBayes(labelCol="label", modelType="bernoulli", smoothing=1.0)),
        "random_forest": ("plain", lambda n: RandomForestClassifier(labelCol="label", numTrees=trees, featureSubsetStrategy="sqrt", minInstancesPerNode=5, maxDepth=7, impurity="gini", seed=42)),
    }


def out_of_fold(df: DataFrame, id_col: str, features: Sequence[str], target: str, model: str, k: int = 5, seed: int = 42, suppressed: str | None = None, trees: int = TREES, iterations: int = ITERATIONS) -> DataFrame:
    """(id, target, prediction, probabilities): every row predicted by a model that didn't see its fold.

    suppressed: a boolean column; such rows are left out of training only.
    """
    how, make = models(trees, iterations)[model]
    numeric, categorical = split_columns(df, features)
    own = folds(prepare(df, numeric, categorical), id_col, k, seed).withColumn("__target", F.col(f"`{target}`").cast("string"))
    own = written(own, "folds")
    labels = StringIndexer(inputCol="__target", outputCol="label", stringOrderType="alphabetAsc").fit(own)
    own = labels.transform(own)
    row = own.agg(*[f(f"x_{c}").alias(f"{n}{i}") for i, c in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max))]).first() if numeric else None
    bounds = {c: (row[f"lo{i}"] or 0.0, row[f"hi{i}"] or 0.0) for i, c in enumerate(numeric)}
    parts = []
    for i in range(k):
        train = own.filter(F.col("fold") != i)
        if suppressed:
            train = train.filter(~F.col(suppressed))
        fitted = Pipeline(stages=[*feature_stages(numeric, categorical, how, bounds), make(train.count())]).fit(train)
        parts.append(fitted.transform(own.filter(F.col("fold") == i)).select(id_col, F.col("__target").alias("truth"), "prediction", vector_to_array("probability").alias("probabilities")))
    out = reduce(DataFrame.unionByName, parts)
    names = F.array(*[F.lit(x) for x in labels.labels])
    return out.select(id_col, "truth", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"), F.map_from_arrays(names, "probabilities").alias("probabilities"))


def zero_r(df: DataFrame, target: str) -> DataFrame:
    """(class, n, prior, predicted): the class shares; the largest is what ZeroR always says."""
    per = df.groupBy(F.col(f"`{target}`").alias("class")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    most = per.agg(F.min(F.struct((-F.col("n")).alias("o"), F.col("class").alias("c")))["c"].alias("top"))
    return per.join(F.broadcast(total)).join(F.broadcast(most)).select("class", "n", (F.col("n") / F.col("total")).alias("prior"), (F.col("class") == F.col("top")).alias("predicted"))


def naive_bayes_counts(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, value, class, n, log_probability): the counts of naive Bayes with Laplace smoothing, by one aggregation."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("nan")).alias("value")) for f in features])
    long = df.select(F.col(f"`{target}`").alias("class"), F.explode(cells).alias("x")).select("class", "x.*")
    per = written(long.groupBy("feature", "value", "class").agg(F.count("*").alias("n")), "bayes")
    values = per.groupBy("feature").agg(F.count_distinct("value").alias("n_values"))
    sizes = per.groupBy("feature", "class").agg(F.sum("n").alias("n_class"))
    return per.join(F.broadcast(values), "feature").join(F.broadcast(sizes), ["feature", "class"]).select("feature", "value", "class", "n", F.log((F.col("n") + 1) / (F.col("n_class") + F.col("n_values"))).alias("log_probability"))


def binary_curve(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """(threshold, tp, fp, n_pos, n_neg): cumulative counts at each distinct score, falling. Only distinct scores are ordered."""
    per = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum(1 - F.col(truth).cast("long")).alias("n"))
    total = per.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    out = running(per, [F.col("threshold").desc()], {"tp": F.col("p"), "fp": F.col("n")})
    return out.join(F.broadcast(total)).select("threshold", "p", "n", "tp", "fp", "n_pos", "n_neg")


def auc(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """One row: the probability that a positive scores above a negative, ties half; null with one class only."""
    c = binary_curve(scored, score, truth)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2.0))
    return c.agg(F.when((F.first("n_pos") > 0) & (F.first("n_neg") > 0), area / (F.first("n_pos") * F.first("n_neg"))).alias("auc"))


def roc_points(scored: DataFrame, score: str = "score", truth: str = "truth", points: int = ROC_POINTS) -> DataFrame:
    """(fpr, tpr) at equispaced false positive rates, linearly interpolated between the curve's points."""
    c = binary_curve(scored, score, truth).select((F.col("fp") / F.col("n_neg")).alias("x"), (F.col("tp") / F.col("n_pos")).alias("y"))
    zero = c.limit(0).unionByName(scored.sparkSession.range(1).select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    # at each rate the curve's last point of it, and the segment to the first point of the next rate
    per = c.unionByName(zero).groupBy("x").agg(F.min("y").alias("y_low"), F.max("y").alias("y_high"))
    at = written(ranked(per, [F.col("x")], "k"), "rates")
    seg = at.join(at.select((F.col("k") - 1).alias("k"), F.col("x").alias("x1"), F.col("y_low").alias("y1")), "k", "left").select("x", "y_low", "y_high", "x1", "y1")
    grid = F.filter(F.array(*[F.lit(i / (points - 1)) for i in range(points)]), lambda g: (g >= F.col("x")) & (F.col("x1").isNull() | (g < F.col("x1"))))
    out = seg.withColumn("fpr", F.explode(grid))
    return out.select("fpr", F.when(F.col("x1").isNull() | (F.col("fpr") == F.col("x")), F.col("y_high")).otherwise(F.col("y_high") + (F.col("y1") - F.col("y_high")) * (F.col("fpr") - F.col("x")) / (F.col("x1") - F.col("x"))).alias("tpr"))


def class_metrics(predicted: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row per class of (truth, predicted, probabilities): sensitivity, specificity, Brier score, AUC."""
    parts = []
    for c in classes:
        is_c, said = F.col("truth") == c, F.col("predicted") == c
        own = predicted.select(is_c.cast("int").alias("truth"), said.alias("said"), F.coalesce(F.element_at("probabilities", F.lit(c)), F.lit(0.0)).alias("score"))
        t = F.col("truth") == 1
        safe = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
        row = own.agg(F.lit(c).alias("class"), safe(F.count_if(t & F.col("said")), F.count_if(t)).alias("sensitivity"), safe(F.count_if(~t & ~F.col("said")), F.count_if(~t)).alias("specificity"), F.avg(F.pow(F.col("score") - F.col("truth"), 2)).alias("brier"))
        parts.append(row.join(F.broadcast(auc(own))))
    return reduce(DataFrame.unionByName, parts)


def accuracy_summary(predicted: DataFrame, baseline: float, original: float | None = None) -> DataFrame:
    """One row: accuracy, baseline, and relative accuracy where the original's accuracy is given and differs from the baseline."""
    acc = F.avg((F.col("truth") == F.col("predicted")).cast("double"))
    out = predicted.agg(F.round(acc, 8).alias("accuracy"), F.lit(round(baseline, 8)).alias("baseline_accuracy"))
    gap = None if original is None else original - baseline
    relative = F.lit(None).cast("double") if gap is None or abs(gap) <= 1e-12 else F.round((F.col("accuracy") - baseline) / gap, 8)
    return out.withColumn("relative_accuracy", relative)


def brier_skill(brier: float, original: float) -> float | None:
    return None if abs(original) < 1e-12 else round(1 - brier / original, 8)
