"""Samples, splits, auxiliary bases and membership targets; all by hashes of the id, so any engine draws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import ranked


#: Rows that are drawn by ordering.
TOP = 100_000


def shuffle_key(id_col: str, seed: int) -> Column:
    return F.sha2(F.concat(F.col(f"`{id_col}`").cast("string"), F.lit(f":{seed}")), 256)


def sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: those with the smallest hashes.

    Up to ``TOP`` rows by a top-n. Above, the hashes' first digits are counted (65,536 cells at most): all rows of the
    cells before the n-th hash stay, and only the rows of its own cell are ordered.
    """
    key = shuffle_key(id_col, seed)
    if n <= TOP:
        return df.orderBy(key, id_col).limit(n)
    cell = F.conv(F.substring(key, 1, 4), 16, 10).cast("int")
    before = 0
    for r in sorted(df.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()):
        if before + r["n"] >= n:
            edge = df.filter(cell == r["cell"]).orderBy(key, id_col).limit(n - before)
            return df.filter(cell < r["cell"]).unionByName(edge)
        before += r["n"]
    return df


def sample_share(df: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """A share of the rows, one at least, in the order of the first column."""
    return sample(df, id_col, max(1, round(df.count() * share)), seed).orderBy(F.col(f"`{df.columns[0]}`"))


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """All rows in the order of their hashes."""
    return df.orderBy(shuffle_key(id_col, seed), id_col)


def held_out_size(total: int, size: int | None = None, share: float | None = None, default: float = 0.1) -> int:
    """Rows to hold out when an attacker is to know ``size`` rows or a ``share`` of all: half of them (the other half is drawn from the release)."""
    if size is not None and share is not None:
        raise ValueError("give either a size or a share")
    if share is not None and not 0 < share < 1 or size is not None and not 0 < size < total:
        raise ValueError("the attacker must know some rows and not all")
    n = size // 2 if size is not None else round(total * (default if share is None else share) / 2)
    if n < 1:
        raise ValueError("too few rows to hold any out")
    return n


def split_record(published: DataFrame, out: DataFrame, id_col: str, seed: int, config: dict | None = None, path: str = "") -> tuple[dict, dict]:
    """(what a split is, for later steps: sizes, shares and seed; the configuration of the release, pointed to the published rows at ``path``)."""
    n, m = published.count(), out.count()
    record = {"id_column": id_col, "seed": seed, "n_total": n + m, "n_published": n, "n_out": m, "out_share": m / (n + m) if n + m else 0.0, "published_path": path}
    return record, dict(config or {}) | {"input": path}


def subset_size(total: int, size: int | None = None, share: float | None = None) -> int:
    """A size or a share, not both; at least 1 and at most the total."""
    if (size is None) == (share is None):
        raise ValueError("give either a size or a share")
    n = size if size is not None else round(total * share)
    if not 1 <= n <= total:
        raise ValueError(f"{n} rows of {total}")
    return n


def split(df: DataFrame, id_col: str, out_size: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(published, out): out has the first ``out_size`` rows of a shuffle."""
    out = sample(df, id_col, out_size, seed)
    return df.join(out.select(id_col), id_col, "left_anti"), out


def three_way(df: DataFrame, id_col: str, out_size: int, in_size: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(published, out, in): in is a sample of the published rows."""
    published, out = split(df, id_col, out_size, seed)
    return published, out, sample(published, id_col, in_size, seed + 1)


def folds(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """``df`` with a column ``fold`` of 0 to k-1."""
    return df.withColumn("fold", (F.conv(F.substring(shuffle_key(id_col, seed), 1, 8), 16, 10).cast("long") % k).cast("int"))


def with_record_id(df: DataFrame, order: Sequence[str], name: str = "record_id") -> DataFrame:
    """Ids 0, 1, ... in a total order, ranked within ranges of it and added up: no task sorts all rows."""
    return ranked(df, [F.col(f"`{c}`") for c in order], "__rank").withColumn(name, F.col("__rank").cast("string")).drop("__rank")


def require_unique(df: DataFrame, id_col: str) -> None:
    r = df.agg(F.count("*").alias("n"), F.count_distinct(F.col(f"`{id_col}`")).alias("d")).first()
    if r["n"] != r["d"]:
        raise ValueError(f"{id_col} is not unique")


def auxiliary_base(original: DataFrame, released: DataFrame, id_col: str, known: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """What an attacker knows: the id and known columns of n rows whose id is in the release, in the order of ids."""
    there = original.join(released.select(id_col), id_col, "left_semi")
    return sample(there, id_col, n, seed).select(id_col, *[F.col(f"`{c}`") for c in known]).orderBy(id_col)


def membership_targets(published: DataFrame, out: DataFrame, released: DataFrame, id_col: str, known: Sequence[str], seed: int = 42) -> DataFrame:
    """As many rows that survived in the release as rows held out, with ``is_member``.

    Fails if a held-out row is in the release.
    """
    if not out.join(released.select(id_col), id_col, "left_semi").isEmpty():
        raise ValueError("held-out rows are in the release")
    survivors = published.join(released.select(id_col), id_col, "left_semi")
    columns = [id_col, *known]
    inside = sample(survivors, id_col, out.count(), seed).select(*[F.col(f"`{c}`") for c in columns]).withColumn("is_member", F.lit(1))
    return inside.unionByName(out.select(*[F.col(f"`{c}`") for c in columns]).withColumn("is_member", F.lit(0)))


def release_figures(published: DataFrame, released: DataFrame, targets: DataFrame, id_col: str) -> DataFrame:
    """One row: published rows, those that survived in the release, the share that the release dropped, members and others among the targets."""
    there = published.join(released.select(id_col), id_col, "left_semi").agg(F.count("*").alias("n_survivors"))
    per = targets.agg(F.count_if(F.col("is_member") == 1).alias("n_in"), F.count_if(F.col("is_member") == 0).alias("n_out"))
    out = published.agg(F.count("*").alias("n_published")).join(F.broadcast(there)).join(F.broadcast(per))
    return out.select("n_published", "n_survivors", F.when(F.col("n_published") > 0, 1 - F.col("n_survivors") / F.col("n_published")).otherwise(0.0).alias("drop_rate"), "n_in", "n_out")
