"""Recovering renamed columns: value overlap, instance vectors, fuzzy overlap, distributions; one-to-one choice; evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import range_midpoint, tokens
from ..sources.scratch import written


def obfuscate(df: DataFrame, columns: Sequence[str], prefix: str = "col_") -> tuple[DataFrame, dict[str, str]]:
    """Columns renamed to prefix0, prefix1, ...; and the truth (new name to old name)."""
    truth = {f"{prefix}{i}": c for i, c in enumerate(columns)}
    return df.withColumnsRenamed({old: new for new, old in truth.items()}), truth


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of all columns in one scan; nulls are no values."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.*").filter("value is not null").distinct()


def jaccard_scores(unknown: DataFrame, known: DataFrame, unknown_columns: Sequence[str], known_columns: Sequence[str]) -> DataFrame:
    """(unknown, known, score) for all pairs of columns: Jaccard similarity of their sets of values."""
    a, b = written(distinct_values(unknown, unknown_columns), "values"), written(distinct_values(known, known_columns), "values")
    na, nb = a.groupBy(F.col("column").alias("unknown")).agg(F.count("*").alias("na")), b.groupBy(F.col("column").alias("known")).agg(F.count("*").alias("nb"))
    both = a.select(F.col("column").alias("unknown"), "value").join(b.select(F.col("column").alias("known"), "value"), "value").groupBy("unknown", "known").agg(F.count("*").alias("n"))
    pairs = unknown.sparkSession.createDataFrame([(u, k) for u in unknown_columns for k in known_columns], "unknown string, known string")
    j = pairs.join(both, ["unknown", "known"], "left").join(F.broadcast(na), "unknown", "left").join(F.broadcast(nb), "known", "left")
    n, x, y = (F.coalesce(c, F.lit(0)) for c in ("n", "na", "nb"))
    return j.select("unknown", "known", F.when(x + y > n, n / (x + y - n)).otherwise(0.0).alias("score"))


def best_by_column(scores: DataFrame, min_score: float = 0.0, order: Sequence[str] = ()) -> DataFrame:
    """(unknown, known, score): the best known column of each unknown one; of ties the first in ``order``. Not one-to-one."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("known")) if order else F.lit(0)
    w = Window.partitionBy("unknown").orderBy(F.col("score").desc(), place, "known")
    return scores.withColumn("k", F.row_number().over(w)).filter((F.col("k") == 1) & (F.col("score") >= min_score)).drop("k")


def one_to_one(scores: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Greedy one-to-one choice by falling score; scores are one row per pair of columns, so the driver does it."""
    rows = sorted(scores.filter(F.col("score") >= min_score).collect(), key=lambda r: (-r["score"], r["unknown"], r["known"]))
    left, right, out = set(), set(), []
    for r in rows:
        if r["unknown"] not in left and r["known"] not in right:
            left.add(r["unknown"])
            right.add(r["known"])
            out.append((r["unknown"], r["known"], float(r["score"])))
    return scores.sparkSession.createDataFrame(out, "unknown string, known string, score double")


def instance_scores(unknown: DataFrame, known: DataFrame, unknown_columns: Sequence[str], known_columns: Sequence[str]) -> DataFrame:
    """Cosine similarity of the columns' TF-IDF vectors of word tokens, columns being the documents."""

    def terms(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
        words = df.select(F.explode(cells).alias("x")).select(F.col("x.column").alias("column"), F.explode(tokens(F.col("x.value"))).alias("term"))
        return words.groupBy("column", "term").agg(F.count("*").alias("tf")).withColumn("side", F.lit(side))

    both = written(terms(unknown, unknown_columns, "u").unionByName(terms(known, known_columns, "k")), "terms")
    n = len(unknown_columns) + len(known_columns)
    idf = both.groupBy("term").agg((F.log(F.lit(float(n)) / F.count("*")) + 1).alias("idf"))
    weighted = both.join(idf, "term").withColumn("w", F.log(1.0 + F.col("tf")) * F.col("idf"))
    norm = weighted.groupBy("side", "column").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighted = weighted.join(F.broadcast(norm), ["side", "column"]).withColumn("w", F.col("w") / F.col("norm"))
    u, k = weighted.filter("side = 'u'").select("term", F.col("column").alias("unknown"), F.col("w").alias("wu")), weighted.filter("side = 'k'").select("term", F.col("column").alias("known"), F.col("w").alias("wk"))
    dots = u.join(k, "term").groupBy("unknown", "known").agg(F.sum(F.col("wu") * F.col("wk")).alias("score"))
    return _filled(dots, unknown_columns, known_columns)


def _filled(scores: DataFrame, unknown_columns: Sequence[str], known_columns: Sequence[str]) -> DataFrame:
    pairs = scores.sparkSession.createDataFrame([(u, k) for u in unknown_columns for k in known_columns], "unknown string, known string")
    return pairs.join(scores, ["unknown", "known"], "left").select("unknown", "known", F.coalesce("score", F.lit(0.0)).alias("score"))


def fuzzy_jaccard_scores(unknown: DataFrame, known: DataFrame, unknown_columns: Sequence[str], known_columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Jaccard where a value is common if the other column has one within 1 - threshold edits of the longer length.

    Candidates share the value itself or two neighbouring characters: with at most a fifth of its characters edited,
    a value keeps a stretch of two or more. The threshold must be 0.8 or more for that.
    """
    if threshold < 0.8:
        raise ValueError("the threshold must be 0.8 or more")
    a, b = written(distinct_values(unknown, unknown_columns), "values"), written(distinct_values(known, known_columns), "values")
    pieces = lambda v: F.array_union(F.array(v), F.transform(F.sequence(F.lit(0), F.greatest(F.length(v) - 2, F.lit(0))), lambda i: F.substring(v, i + 1, F.lit(2))))
    left = a.select(F.col("column").alias("unknown"), F.col("value").alias("x")).withColumn("piece", F.explode(F.array_distinct(pieces(F.col("x")))))
    right = b.select(F.col("column").alias("known"), F.col("value").alias("y")).withColumn("piece", F.explode(F.array_distinct(pieces(F.col("y")))))
    near = left.join(right, "piece").filter(F.levenshtein("x", "y") <= (1 - threshold) * F.greatest(F.length("x"), F.length("y")) + 1e-9)
    hits = near.groupBy("unknown", "known").agg(F.count_distinct("x").alias("n"))
    na, nb = a.groupBy(F.col("column").alias("unknown")).agg(F.count("*").alias("na")), b.groupBy(F.col("column").alias("known")).agg(F.count("*").alias("nb"))
    j = hits.join(F.broadcast(na), "unknown").join(F.broadcast(nb), "known")
    return _filled(j.select("unknown", "known", F.least(F.lit(1.0), F.col("n") / F.greatest(F.col("na") + F.col("nb") - F.col("n"), F.lit(1))).alias("score")), unknown_columns, known_columns)


def distribution_scores(unknown: DataFrame, known: DataFrame, unknown_columns: Sequence[str], known_columns: Sequence[str], points: int = 21) -> DataFrame:
    """1 - mean distance of quantiles over the joint range, for columns of numbers; 0 for others."""
    shares = [i / (points - 1) for i in range(points)]
    grab = lambda df, cs: df.agg(*[F.percentile_approx(range_midpoint(F.col(f"`{c}`")), shares, 10_000).alias(f"q{i}") for i, c in enumerate(cs)]).first() if cs else None
    u, k = grab(unknown, unknown_columns), grab(known, known_columns)
    out = []
    for i, a in enumerate(unknown_columns):
        for j, b in enumerate(known_columns):
            x, y = u[f"q{i}"], k[f"q{j}"]
            span = max(max(x), max(y)) - min(min(x), min(y)) if x and y else 0.0
            out.append((a, b, 0.0 if not x or not y else 1.0 if not span else max(0.0, 1 - sum(abs(p - q) for p, q in zip(x, y, strict=True)) / points / span)))
    return unknown.sparkSession.createDataFrame(out, "unknown string, known string, score double")


def evaluate_mapping(mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_columns, n_mapped, n_correct, coverage, accuracy_on_mapped, recall (null where nothing is to divide by).

    mapping: (unknown, known, ...); truth: (unknown, known).
    """
    j = truth.select("unknown", F.col("known").alias("true_known")).join(mapping.select("unknown", "known"), "unknown", "left")
    c = j.agg(F.count("*").alias("n_columns"), F.count("known").alias("n_mapped"), F.count_if(F.col("known") == F.col("true_known")).alias("n_correct"))
    safe = lambda top, bottom: F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))
    return c.select("*", safe("n_mapped", "n_columns").alias("coverage"), safe("n_correct", "n_mapped").alias("accuracy_on_mapped"), safe("n_correct", "n_columns").alias("recall"))


def unrecoverable(mapping: DataFrame, needed: Sequence[str]) -> list[str]:
    """Of the needed attributes those that no column was mapped to; an attack leaves them out."""
    have = {r["known"] for r in mapping.select("known").distinct().collect()}
    return [a for a in needed if a not in have]


MATCHERS = {"jaccard_baseline": jaccard_scores, "instances": instance_scores, "jaccard": fuzzy_jaccard_scores, "distribution": distribution_scores}


def recover(unknown: DataFrame, known: DataFrame, unknown_columns: Sequence[str], known_columns: Sequence[str], matcher: str = "jaccard_baseline", min_score: float = 0.0) -> DataFrame:
    """(unknown, known, score) by any matcher; the baseline takes each column's best, the others choose one-to-one."""
    if matcher not in MATCHERS:
        raise ValueError(f"unknown matcher: {matcher}")
    scores = MATCHERS[matcher](unknown, known, unknown_columns, known_columns)
    return best_by_column(scores, min_score, known_columns) if matcher == "jaccard_baseline" else one_to_one(scores, min_score)

