"""Similarity matching of candidate pairs, and threshold updates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.bloom import packed, shared_bits, similarity
from ...sources.scratch import spread, written
from .encode import attributes

METRICS = ("dice", "jaccard", "cosine", "scm", "tversky")


def score_pairs(encoded: DataFrame, pairs: DataFrame | None, size: int, metric: str = "dice", attrs: Sequence[str] | None = None, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(id1, id2, weight): the mean over attributes of the similarity of both records' bits.

    Filters are packed into 64-bit words once for each record; a pair costs an AND and a bit count
    for each word. Without pairs all records of side 0 meet all of side 1 (the smaller side is broadcast
    by its size where it is small). An unknown metric is dice. Filters may come packed, as ``words``.
    """
    dense = "words" in encoded.columns
    own = ["words"] if dense else list(attrs or attributes(encoded))
    if dense:
        words = [F.struct(F.col("words").alias("w"), shared_bits(F.col("words"), F.col("words"), size).alias("n")).alias("f_words")]
    else:
        words = [F.struct(packed(F.col(f"bits_{a}"), size).alias("w"), F.size(f"bits_{a}").alias("n")).alias(f"f_{a}") for a in own]
    filters = written(spread(encoded).select("side", "id", *words), "filters")
    side = lambda s: filters.filter(F.col("side") == s).select(F.col("id").alias(f"id{s + 1}"), *[F.col(f"f_{a}").alias(f"f{s + 1}_{a}") for a in own])
    j = side(0).join(side(1), how="cross") if pairs is None else pairs.select("id1", "id2").join(side(0), "id1").join(side(1), "id2")
    name = metric if metric in METRICS else "dice"
    one = lambda a: similarity(name, shared_bits(F.col(f"f1_{a}.w"), F.col(f"f2_{a}.w"), size), F.col(f"f1_{a}.n"), F.col(f"f2_{a}.n"), size, alpha, beta)
    return j.select("id1", "id2", (reduce(lambda a, b: a + b, [one(a) for a in own]) / len(own)).alias("weight"))


def predict(encoded: DataFrame, pairs: DataFrame | None, size: int, metric: str = "dice", threshold: float = 0.6, attrs: Sequence[str] | None = None) -> DataFrame:
    """Pairs whose similarity is at least the threshold."""
    return score_pairs(encoded, pairs, size, metric, attrs).filter(F.col("weight") >= threshold)


def update_graph(edges: DataFrame, threshold: float) -> DataFrame:
    """Pairs strictly above a new threshold."""
    return edges.filter(F.col("weight") > threshold)
