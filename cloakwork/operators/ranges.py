"""Orders over whole tables without one task that sees all rows: ranges of the order, sums within them, sums of the ranges before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with columns that sum up, in the order (which must be total), all rows up to and with each row.

    The ranges are written once: their numbers are what ties the two steps together. One row a range is windowed as a whole.
    """
    ranged = written(df.select("*", *[c.alias(f"__{n}") for n, c in sums.items()]).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("__part").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    upto = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(f"__{n}").over(upto).alias(f"__u_{n}") for n in sums]).join(F.broadcast(per), "__part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__b_{n}") + F.coalesce(f"__u_{n}", F.lit(0))).alias(n) for n in sums])


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with its rank 0, 1, ... in a total order."""
    return running(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def carried(df: DataFrame, order: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """``df`` where nulls of the columns ``names`` are the last value before in a total order."""
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), place)).alias(f"__t_{n}") for n in names]
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy("__part").agg(*last).select("__part", *[F.last(f"__t_{n}", ignorenulls=True).over(before).alias(f"__b_{n}") for n in names])
    upto = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.last(n, ignorenulls=True).over(upto).alias(f"__u_{n}") for n in names]).join(F.broadcast(per), "__part")
    return out.select(*[F.coalesce(f"__u_{c}", f"__b_{c}").alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])
