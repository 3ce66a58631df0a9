"""Generalization hierarchies: as tables of leaves, or as expressions over the raw value."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hierarchy:
    """Levels of one attribute, from the raw value (level 0) to ``*``.

    Either ``exprs``: one expression for each level over the raw value, no join at all; or
    ``table``: (leaf, levels), joined by leaf (its leaves are known, so it is broadcast if small).
    """

    attr: str
    exprs: tuple[Callable[[Column], Column], ...] = ()
    table: DataFrame | None = None
    depth: int = 0

    @property
    def levels(self) -> int:
        return len(self.exprs) or self.depth

    def labels(self, value: Column) -> Column:
        """The labels of all levels of a value."""
        return F.array(*[e(value).cast("string") for e in self.exprs])


def by_expression(attr: str, *levels: Callable[[Column], Column]) -> Hierarchy:
    return Hierarchy(attr, exprs=(lambda c: c, *levels, lambda c: F.lit("*")))


def by_table(attr: str, table: DataFrame) -> Hierarchy:
    """table: (leaf, levels), as ``read_hierarchy`` gives it; a ragged row's last label goes on upwards."""
    depth = table.agg(F.max(F.size("levels"))).first()[0] or 1
    full = F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda i: F.element_at("levels", F.least(i, F.size("levels"))))
    return Hierarchy(attr, table=table.select("leaf", full.alias("levels")), depth=depth)


def band(width: int) -> Callable[[Column], Column]:
    """``lo-hi`` of the fixed-width band that a number (not below 0) is in."""

    def label(c: Column) -> Column:
        lo = (F.floor(F.greatest(c.cast("double"), F.lit(0.0)) / width) * width).cast("long")
        return F.concat_ws("-", lo.cast("string"), (lo + width).cast("string"))

    return label


def with_levels(df: DataFrame, hierarchies: Sequence[Hierarchy]) -> DataFrame:
    """``df`` with a column ``levels_<attr>`` for each hierarchy; a value that a table lacks is its own label below ``*``."""
    for h in hierarchies:
        name = f"levels_{h.attr}"
        if h.exprs:
            df = df.withColumn(name, h.labels(F.col(f"`{h.attr}`")))
        else:
            own = h.table.select(F.col("leaf").alias("__leaf"), F.col("levels").alias(name))
            value = F.col(f"`{h.attr}`").cast("string")
            bare = F.array(*([value] * (h.levels - 1)), F.lit("*"))
            df = df.join(own, value == F.col("__leaf"), "left").drop("__leaf").withColumn(name, F.coalesce(F.col(name), bare))
    return df


def generalize(df: DataFrame, hierarchies: Sequence[Hierarchy], node: dict[str, int]) -> DataFrame:
    """Every hierarchy's attribute replaced by its label at the node's level (capped at the top)."""
    df = with_levels(df, hierarchies)
    for h in hierarchies:
        level = min(node.get(h.attr, 0), h.levels - 1)
        df = df.withColumn(h.attr, F.col(f"levels_{h.attr}")[level])
    return df.drop(*[f"levels_{h.attr}" for h in hierarchies])
