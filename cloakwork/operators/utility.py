"""Statistical utility: how far the distributions of a release are from the original's."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import range_midpoint
from ..sources.scratch import written
from .ranges import carried, ranked, running

SMOOTHING, BINS = 1e-10, 20


def numeric_form(df: DataFrame, column: str, threshold: float = 0.5) -> Column | None:
    """How a column becomes numbers: as it is, by midpoints, or not at all (None); one probe over all rows."""
    c = F.col(f"`{column}`")
    plain, middle = F.expr(f"try_cast(`{column}` as double)"), range_midpoint(c)
    r = df.agg(F.avg(plain.isNotNull().cast("double")), F.avg(middle.isNotNull().cast("double"))).first()
    if r[0] is not None and r[0] > threshold:
        return plain
    return middle if r[1] is not None and r[1] > threshold else None


def _binned(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bins, the last one closed; values outside have none. One value only: half to each side of it."""
    low, high = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    at = F.floor((x - low) / (high - low) * bins)
    return F.when((x >= low) & (x <= high), F.least(at, F.lit(bins - 1)))


def histograms(orig: DataFrame, anon: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(v, p, q): counts of each bin or category in the original and the release; 0 where a side lacks it.

    Bins over the original's range if both sides are numeric, else categories of the texts.
    """
    a, b = numeric_form(orig, column), numeric_form(anon, column)
    if a is not None and b is not None:
        span = F.broadcast(orig.agg(F.min(a).alias("lo"), F.max(a).alias("hi")))
        of = lambda df, x: df.select(x.alias("x")).filter("x is not null").join(span).select(_binned(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("v")).filter("v is not null")
        left, right = of(orig, a), of(anon, b)
        edges = orig.sparkSession.range(bins).select(F.col("id").alias("v"))
        p, q = left.groupBy("v").agg(F.count("*").alias("p")), right.groupBy("v").agg(F.count("*").alias("q"))
        return edges.join(p, "v", "left").join(q, "v", "left").select("v", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    text = lambda df, n: df.groupBy(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("nan")).alias("v")).agg(F.count("*").alias(n))
    return text(orig, "p").join(text(anon, "q"), "v", "full").select("v", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))


def divergences(orig: DataFrame, anon: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """One row: kl_divergence (smoothed, natural log) and tvd."""
    h = histograms(orig, anon, column, bins)
    total = h.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"), F.count("*").alias("cells"))
    j = h.join(F.broadcast(total))
    p, q = (F.col("p") + SMOOTHING) / (F.col("np") + F.col("cells") * SMOOTHING), (F.col("q") + SMOOTHING) / (F.col("nq") + F.col("cells") * SMOOTHING)
    return j.agg(F.sum(p * F.log(p / q)).alias("kl_divergence"), (0.5 * F.sum(F.abs(F.col("p") / F.col("np") - F.col("q") / F.col("nq")))).alias("tvd"))


def _quantile_steps(df: DataFrame, x: Column, side: str) -> DataFrame:
    """(value, first, last, n): the ranks of each distinct value, by a distributed prefix sum over ranges of values."""
    values = df.select(x.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    out = running(values, [F.col("v")], {"upto": F.col("c")})
    return out.select("v", (F.col("upto") - F.col("c")).alias(f"first_{side}"), (F.col("upto") - 1).alias(f"last_{side}"))


def _quantile_line(df: DataFrame, x: Column, size: int, top: int, side: str) -> DataFrame:
    """(i, <side>): the quantile function at ``top`` equispaced points, as the straight pieces that begin at point i; <side> is struct(at, slope).

    Two pieces for each distinct value: constant over its ranks, then a line to the next value.
    """
    step = (size - 1) / max(top - 1, 1)
    runs = ranked(_quantile_steps(df, x, "x"), [F.col("first_x")], "k")
    runs = written(runs, "runs")
    after = runs.select((F.col("k") - 1).alias("k"), F.col("v").alias("next"))
    runs = runs.join(after, "k", "left").withColumn("next", F.coalesce("next", "v"))
    # the first point whose rank is at least r
    first = lambda r: F.greatest(F.ceil((r - F.lit(1e-9)) / F.lit(step)), F.lit(0)).cast("long") if step else F.when(r <= 0, F.lit(0)).otherwise(F.lit(top)).cast("long")
    flat = F.struct(first(F.col("first_x")).alias("i"), F.lit(0).alias("o"), F.col("v").alias("at"), F.lit(0.0).alias("slope"))
    begin = first(F.col("last_x"))
    ramp = F.struct(begin.alias("i"), F.lit(1).alias("o"), (F.col("v") + (F.col("next") - F.col("v")) * F.greatest(begin * step - F.col("last_x"), F.lit(0.0))).alias("at"), ((F.col("next") - F.col("v")) * step).alias("slope"))
    pieces = runs.select("k", F.explode(F.array(flat, ramp)).alias("p")).select("k", "p.*").filter(F.col("i") < top)
    # of pieces that begin at the same point the last one holds
    return pieces.groupBy("i").agg(F.max_by(F.struct("at", "slope"), F.struct("k", "o")).alias(side))


def wasserstein(orig: DataFrame, anon: DataFrame, column: str) -> DataFrame:
    """One row: the mean absolute difference of the two quantile functions at max(n) equispaced points, linearly interpolated.

    Null if a side has no numbers. Both functions are straight between few points: the rows are the merged pieces of both
    sides, two at most for each distinct value, and each is summed up by a formula, however many points it spans.
    """
    a, b = numeric_form(orig, column), numeric_form(anon, column)
    if a is None or b is None:
        return orig.sparkSession.range(1).select(F.lit(None).cast("double").alias("wasserstein"))
    n = orig.select(a.alias("v")).agg(F.count("v")).first()[0], anon.select(b.alias("v")).agg(F.count("v")).first()[0]
    top = max(n)
    both = _quantile_line(orig, a, n[0], top, "x").join(_quantile_line(anon, b, n[1], top, "y"), "i", "full")
    begin = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.col("i").alias("from"), f"{s}.at", f"{s}.slope"))
    filled = carried(both.select("i", begin("x").alias("x"), begin("y").alias("y")), [F.col("i")], ["x", "y"])
    at = lambda s: F.col(f"{s}.at") + F.col(f"{s}.slope") * (F.col("i") - F.col(f"{s}.from"))
    lines = written(ranked(filled.select("i", (at("x") - at("y")).alias("d"), (F.col("x.slope") - F.col("y.slope")).alias("slope")), [F.col("i")], "k"), "lines")
    spans = lines.join(lines.select((F.col("k") - 1).alias("k"), F.col("i").alias("end")), "k", "left").withColumn("n", F.coalesce("end", F.lit(top)) - F.col("i"))
    total = lambda m, d: F.abs(m * d + F.col("slope") * m * (m - 1) / 2)
    # the points before the line crosses 0, and those after
    split = F.least(F.greatest(F.when(F.col("slope") != 0, F.floor(-F.col("d") / F.col("slope")) + 1).otherwise(0), F.lit(0)), F.col("n"))
    spans = spans.withColumn("m", split.cast("long"))
    area = total(F.col("m"), F.col("d")) + total(F.col("n") - F.col("m"), F.col("d") + F.col("slope") * F.col("m"))
    return spans.agg((F.sum(area) / F.lit(float(max(top, 1)))).alias("wasserstein"))


def mean_std_delta(orig: DataFrame, anon: DataFrame, column: str) -> DataFrame:
    """One row: mean_delta, std_delta and both relative to the original (null where that is 0)."""
    a, b = numeric_form(orig, column), numeric_form(anon, column)
    if a is None or b is None:
        return orig.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in ("mean_delta", "std_delta", "mean_delta_relative", "std_delta_relative")])
    x, y = orig.agg(F.avg(a).alias("ma"), F.stddev_samp(a).alias("sa")), anon.agg(F.avg(b).alias("mb"), F.stddev_samp(b).alias("sb"))
    m, s = F.abs(F.col("ma") - F.col("mb")), F.abs(F.col("sa") - F.col("sb"))
    return x.join(F.broadcast(y)).select(m.alias("mean_delta"), s.alias("std_delta"), F.when(F.col("ma") != 0, m / F.abs("ma")).alias("mean_delta_relative"), F.when(F.col("sa") != 0, s / F.col("sa")).alias("std_delta_relative"))


def encoded_for_correlation(orig: DataFrame, anon: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides as numbers: plain if more than half of both sides are, midpoints if more than 30 % are, else codes over the sorted union of texts."""
    outs: list[list[Column]] = [[], []]
    sides = [orig, anon]
    for i, c in enumerate(columns):
        plain, middle = F.expr(f"try_cast(`{c}` as double)"), range_midpoint(F.col(f"`{c}`"))
        shares = [df.agg(F.avg(plain.isNotNull().cast("double")), F.avg(middle.isNotNull().cast("double"))).first() for df in (orig, anon)]
        if all((s[0] or 0) > 0.5 for s in shares):
            form = plain
        elif all((s[1] or 0) > 0.3 for s in shares):
            form = middle
        else:
            text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))
            union = orig.select(text.alias("t")).union(anon.select(text.alias("t"))).distinct()
            codes = ranked(union, [F.col("t")], "code").select(F.col("t").alias(f"t{i}"), F.col("code").cast("double").alias(f"code{i}"))
            sides = [df.join(codes, text == F.col(f"t{i}"), "left") for df in sides]
            form = F.col(f"code{i}")
        for o in outs:
            o.append(form.alias(f"e{i}"))
    return sides[0].select(*outs[0]), sides[1].select(*outs[1])


def correlation_delta(orig: DataFrame, anon: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: frobenius (norm of the difference of the correlation matrices, missing correlations 0) and frobenius_normalized."""
    n = len(columns)
    if n < 2:
        return orig.sparkSession.range(1).select(F.lit(None).cast("double").alias("frobenius"), F.lit(None).cast("double").alias("frobenius_normalized"))
    pairs = [(i, j) for i in range(n) for j in range(i)]
    both = encoded_for_correlation(orig, anon, columns)

    def r(df: DataFrame, side: str) -> DataFrame:
        one = lambda i, j: F.corr(F.when(F.col(f"e{j}").isNotNull(), F.col(f"e{i}")), F.when(F.col(f"e{i}").isNotNull(), F.col(f"e{j}")))
        return df.agg(*[F.coalesce(F.nanvl(one(i, j), F.lit(None)), F.lit(0.0)).alias(f"{side}{k}") for k, (i, j) in enumerate(pairs)])

    squares = reduce(lambda a, b: a + b, [F.pow(F.col(f"x{k}") - F.col(f"y{k}"), 2) for k in range(len(pairs))])
    norm = F.sqrt(2 * squares)
    return r(both[0], "x").join(F.broadcast(r(both[1], "y"))).select(norm.alias("frobenius"), (norm / (2 * (n * (n - 1)) ** 0.5)).alias("frobenius_normalized"))


def column_metrics(orig: DataFrame, anon: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column that both sides have: all metrics above, and the Wasserstein distance over the original's deviation."""
    parts = []
    for c in columns:
        if c not in orig.columns or c not in anon.columns:
            continue
        form = numeric_form(orig, c)
        deviation = orig.agg(F.stddev_pop(form).alias("sd")) if form is not None else orig.sparkSession.range(1).select(F.lit(None).cast("double").alias("sd"))
        row = divergences(orig, anon, c).join(F.broadcast(wasserstein(orig, anon, c))).join(F.broadcast(mean_std_delta(orig, anon, c))).join(F.broadcast(deviation))
        parts.append(row.select(F.lit(c).alias("column"), "kl_divergence", "tvd", "wasserstein", F.when(F.col("sd") > 0, F.col("wasserstein") / F.col("sd")).alias("wasserstein_normalized"), "mean_delta", "std_delta", "mean_delta_relative", "std_delta_relative"))
    return reduce(DataFrame.unionByName, parts)


def summary(orig: DataFrame, anon: DataFrame, qis: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    """One row over a data set: rows, suppression rate, mean metrics of quasi-identifiers, sensitive and all columns."""
    m = column_metrics(orig, anon, [*qis, *sensitive])
    counts = orig.agg(F.count("*").alias("n_original")).join(F.broadcast(anon.agg(F.count("*").alias("n_anonymized"))))
    of = lambda c, names: F.avg(F.when(F.col("column").isin(list(names)), F.col(c)))
    means = m.agg(of("tvd", qis).alias("mean_tvd_qi"), of("tvd", sensitive).alias("mean_tvd_sensitive"), F.avg("tvd").alias("mean_tvd_all"), of("kl_divergence", qis).alias("mean_kl_qi"), of("wasserstein", qis).alias("mean_wasserstein_qi"), F.avg("wasserstein").alias("mean_wasserstein_all"))
    rate = F.bround(1 - F.col("n_anonymized") / F.col("n_original"), 6).alias("suppression_rate")
    return counts.join(F.broadcast(means)).select("n_original", "n_anonymized", rate, *means.columns)
