"""Tables that reports are made of: grouped statistics, histograms, keep-first and keep-last, chi-square; and plain HTML."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, median, mean, std (sample; 0 for one row), min, max of each group, in the order of the keys."""
    v = F.col(f"`{value}`")
    out = df.groupBy(*keys).agg(F.count(v).alias("count"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.na.fill(0).orderBy(*keys)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    per = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"))
    return per.join(F.broadcast(per.agg(F.sum("n").alias("total")))).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.when(hi > lo, F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).otherwise(0).cast("int")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, lo, hi, n) of equal widths, the last closed; equal values only: one bin. Empty bins are left out."""
    v = F.col(f"`{value}`").cast("double")
    span = df.agg(F.min(v).alias("a"), F.max(v).alias("b"))
    j = df.select(v.alias("v")).filter("v is not null").join(F.broadcast(span))
    w = (F.col("b") - F.col("a")) / bins
    per = j.groupBy(_bin(F.col("v"), F.col("a"), F.col("b"), bins).alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    return per.select("bin", (F.col("a") + F.col("bin") * w).alias("lo"), (F.col("a") + (F.col("bin") + 1) * w).alias("hi"), "n")


def grouped_histogram(df: DataFrame, value: str, member: str, bins: int = 10) -> DataFrame:
    """(bin, n_in, n_out) on common bins."""
    v = F.col(f"`{value}`").cast("double")
    span = df.agg(F.min(v).alias("a"), F.max(v).alias("b"))
    j = df.select(v.alias("v"), (F.col(f"`{member}`") == 1).alias("m")).filter("v is not null").join(F.broadcast(span))
    return j.groupBy(_bin(F.col("v"), F.col("a"), F.col("b"), bins).alias("bin")).agg(F.count_if("m").alias("n_in"), F.count_if(~F.col("m")).alias("n_out"))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order: keep-first, or keep-last with the order turned."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def most_common(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n): the most frequent value, of ties the smallest."""
    per = df.groupBy(*keys, F.col(f"`{value}`").alias("__v")).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col("__v").alias("v"))).alias("x")).select(*keys, F.col("x.v").alias(value), (-F.col("x.o")).alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 = sum (observed - expected)^2 / expected over all cells, empty ones included, and the degrees of freedom.

    sum o^2/e - n needs the cells that occur only.
    """
    cells = df.groupBy(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).agg(F.count("*").alias("o"))
    ra, rb = cells.groupBy("a").agg(F.sum("o").alias("na")), cells.groupBy("b").agg(F.sum("o").alias("nb"))
    total = cells.agg(F.sum("o").alias("n"))
    j = cells.join(ra, "a").join(rb, "b").join(F.broadcast(total))
    o, n = F.col("o").cast("double"), F.col("n")
    out = j.agg((F.sum(o * o * n / (F.col("na") * F.col("nb"))) - F.first("n")).alias("chi2"))
    dof = ra.agg((F.count("*") - 1).alias("x")).join(F.broadcast(rb.agg((F.count("*") - 1).alias("y")))).select((F.col("x") * F.col("y")).alias("dof"))
    return out.join(F.broadcast(dof))


def to_bool(c: Column) -> Column:
    """true, 1 and yes, false, 0 and no, in any case; all else null."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "1", "1.0", "yes"), True).when(text.isin("false", "0", "0.0", "no"), False)


def shown(x) -> str:
    """A value as text: thousands parted by narrow blanks, a decimal comma, at most six digits after it."""
    if x is None:
        return ""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return html.escape(str(x))
    text = f"{x:,}" if isinstance(x, int) else f"{x:,.6f}".rstrip("0").rstrip(".")
    return text.replace(",", "\u202f").replace(".", ",")


def percent(x: float | None) -> str:
    return "" if x is None else f"{shown(round(100 * float(x), 2))}\u202f%"


def section(title: str, df: DataFrame, most: int = 1000) -> str:
    """A heading and the first rows of a result as a table; it says if there are more."""
    rows = df.limit(most + 1).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{shown(x)}</td>" for x in r) + "</tr>" for r in rows[:most])
    more = f"<p>The first {most} rows.</p>" if len(rows) > most else ""
    return f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>{more}"


def bars(title: str, df: DataFrame, label: str, value: str, most: int = 100) -> str:
    """A heading and a bar for each of the first rows."""
    rows = [(r[0], float(r[1] or 0)) for r in df.select(label, value).limit(most).collect()]
    top = max((v for _, v in rows), default=0) or 1
    body = "".join(f"<tr><td>{shown(k)}</td><td><div style='background:#469;height:1em;width:{20 * v / top:.2f}em'></div></td><td>{shown(v)}</td></tr>" for k, v in rows)
    return f"<h2>{html.escape(title)}</h2><table>{body}</table>"


def page(title: str, sections: Sequence[str]) -> str:
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(sections)}"


def html_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A plain page of the first rows of a small result."""
    return page(title, [section(title, df, most)])
