"""Quality selection by importance resampling.

Two generative models over hashed word 1- and 2-grams, one of the target text and one of the raw
text; a document's weight is the log ratio of its probability under both, summed over its n-grams.
Adding Gumbel noise (from a hash of the id, so reruns agree) and keeping the k largest draws k
documents without replacement in proportion to their weights.

*Target*: the ``target_rows`` documents of the labelled rows with quality 1 (and not toxic) whose ids
have the smallest hashes, a bounded sample. *Raw*: the n-grams of all documents; each task adds up
its own, one aggregation adds those. *k* is by default the share of quality 1 among all labelled rows, of
all documents. The k-th largest value is found by narrowing a histogram of bounded size, so no
task sorts all rows; of equal values the smaller ids stay.

Texts that are null or empty have weight 0 (as likely under both models). Without labelled rows
there is no target: the weights are 0 and all documents stay. Rows that repeat are drawn as one if id and text are equal.
Texts of any length are counted whole. Columns of the documents other than the id and the text are not read, so their names can clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, utf8, written

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
_BINS = 4096


def grams(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the 1- and 2-grams of a text's word hashes."""
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[1:]
    pairs *= np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate((hashes >> np.uint64(40), pairs >> np.uint64(40))).astype(np.int64) & (buckets - 1)


def gram_counts(docs: DataFrame, chosen: frozenset | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all of ``docs`` (id, text), and over those whose id is chosen."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen or frozenset())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, good = WordHasher(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for i, h in zip(batch.column(0).to_pylist(), hasher.texts(utf8(batch.column(1))), strict=True):
                c = np.bincount(grams(h), minlength=BUCKETS) if len(h) > 1000 else None
                for into in (total, good) if i in shared.value else (total,):
                    if c is None:
                        np.add.at(into, grams(h), 1)
                    else:
                        into += c
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64()), pa.array(good[hit], pa.int64())], names=["bucket", "n", "good"])

    found = docs.mapInArrow(run, "bucket int, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toArrow()
    out = np.zeros((2, BUCKETS))
    out[0, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    out[1, found.column("bucket").to_numpy()] = found.column("good").to_numpy()
    return out[0], out[1]


def log_ratios(raw: np.ndarray, target: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw); 0 everywhere without a target."""
    if not target.sum():
        return np.zeros(len(raw))
    logs = lambda c: np.log(c + alpha) - np.log(c.sum() + alpha * len(c))
    return logs(target) - logs(raw)


def weighted(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(id, n_grams, log_ratio) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            own = [grams(h) for h in hasher.texts(utf8(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in own], pa.int64()), pa.array([float(shared.value[g].sum()) for g in own], pa.float64())], names=["id", "n_grams", "log_ratio"])

    return docs.mapInArrow(run, "id long, n_grams long, log_ratio double")


def top_k(rows: DataFrame, k: int, key: str = "key", id_col: str = "id") -> DataFrame:
    """``rows`` (a written table, keys not null) with ``kept``: the k largest keys, of equal ones the smaller ids."""
    total, lo, hi = rows.agg(F.count("*"), F.min(key), F.max(key)).first()
    if k >= total:
        return rows.withColumn("kept", F.lit(True))
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    need = k
    while True:
        span = rows.filter(F.col(key).between(lo, hi))
        if not (hi > lo) or (hi - lo) / _BINS <= abs(hi) * 1e-15:
            break
        width = (hi - lo) / _BINS
        at = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)), F.lit(_BINS - 1))
        bins = sorted(span.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect(), key=lambda r: -r["bin"])
        for r in bins:
            if r["n"] >= need:
                break
            need -= r["n"]
        lo, hi = r["lo"], r["hi"]
        if r["n"] <= 10_000:
            break
    # need of the rows between lo and hi stay; all above do
    edge = span.filter(F.col(key).between(lo, hi)).select(F.col(key).alias("k"), F.col(id_col).alias("i")).orderBy(F.col("k").desc(), F.col("i").asc_nulls_last()).limit(need)
    last = edge.orderBy(F.col("k").asc(), F.col("i").desc_nulls_first()).first()
    tie = F.lit(True) if last["i"] is None else F.coalesce(F.col(id_col) <= F.lit(last["i"]), F.lit(False))
    return rows.withColumn("kept", (F.col(key) > F.lit(last["k"])) | ((F.col(key) == F.lit(last["k"])) & tie))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, target_rows: int = TARGET_ROWS, seed: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, n_grams, log_ratio, key (with Gumbel noise), kept.

    labels: id_col, quality (1 is target), toxic. share: of the documents to keep.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    good = known.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col(id_col).cast("long").alias("id"))
    chosen = good.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(target_rows).collect()
    if share is None:
        n, ones = known.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("long"))).first()
        share = ones / n if n else 1.0
    ratios = log_ratios(*gram_counts(own, frozenset(r["id"] for r in chosen)))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce("id", F.lit(-1)), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rows = weighted(own, ratios).withColumn("key", F.col("log_ratio") - F.log(-F.log(uniform)))
    rows = written(rows, "op5-keys")
    return top_k(rows, round(share * rows.count())).withColumnRenamed("id", id_col)
