"""What an attacker learns from a release: visible levels, record linkage, membership inference.

Both attacks work on distinct tuples: targets that look alike through the release's hierarchies share one
class of candidates, and release rows that look alike are one tuple with a count. Rows are only
joined where a later stage needs them, by equality of whole tuples; suppressed release tuples
(stars) are few and joined by what remains of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_suppressed
from ..sources.files import suppressed_columns
from .hierarchy import Hierarchy, with_levels
from .ranges import running


def visible_levels(release: DataFrame, hierarchies: Sequence[Hierarchy], raw: DataFrame | None = None) -> DataFrame:
    """(attr, visible_level): the most specific level whose labels cover all values of the release that are not suppressed; 0 if none does.

    raw: where a hierarchy of expressions takes its leaves from (default: its table).
    """
    parts = []
    for h in hierarchies:
        values = release.select(F.col(f"`{h.attr}`").cast("string").alias("v")).filter(~is_suppressed(F.col("v"))).distinct()
        leaves = h.table.select("levels") if h.table is not None else with_levels(raw.select(F.col(f"`{h.attr}`")).distinct(), [h]).select(F.col(f"`levels_{h.attr}`").alias("levels"))
        labels = leaves.select(F.posexplode("levels").alias("level", "v")).distinct()
        covered = values.join(labels, "v").groupBy("level").agg(F.count("*").alias("n"))
        total = values.agg(F.count("*").alias("total"))
        parts.append(covered.join(F.broadcast(total)).filter("n = total and total > 0").agg(F.lit(h.attr).alias("attr"), F.coalesce(F.min("level"), F.lit(0)).alias("visible_level")))
    return reduce(DataFrame.unionByName, parts)


def with_suppressed_columns(levels: dict[str, int], release: DataFrame, known: Sequence[str]) -> dict[str, int]:
    """``levels`` where a known attribute that the release suppresses in every row, though it seems to be in clear, is at level 1: it filters nothing."""
    own = [a for a in known if levels.get(a) == 0 and a in release.columns]
    return dict(levels) | dict.fromkeys(suppressed_columns(release, own), 1)


def known_attributes(targets: DataFrame, id_col: str, known: Sequence[str] = (), member_col: str = "is_member") -> list[str]:
    """What an attacker knows: the given attributes, or all columns of the targets but the id and the membership."""
    return list(known) or [c for c in targets.columns if c not in (id_col, member_col)]


def mapped_known(known: Sequence[str], mapping: dict[str, str]) -> tuple[list[str], list[str]]:
    """(attributes that a recovered schema still has, attributes that it lost). mapping: column of the release to the name that it was recognised as."""
    found = set(mapping.values())
    return [a for a in known if a in found], [a for a in known if a not in found]


def compatibility(target: Column, projected: Column, released: Column, similarity: Column | None = None, threshold: float = 0.8) -> Column:
    """struct(kind, score) of a target's value and a released one: exact 1, suppressed 0.25, generalized 0.5, fuzzy its similarity, none 0."""
    one = lambda kind, score: F.struct(F.lit(kind).alias("kind"), (score if isinstance(score, Column) else F.lit(float(score))).alias("score"))
    text = F.trim(released.cast("string"))
    out = F.when(F.trim(target.cast("string")) == text, one("exact", 1)).when(is_suppressed(released), one("suppressed", 0.25)).when(projected == text, one("generalized", 0.5))
    if similarity is not None:
        out = out.when(similarity >= threshold, one("fuzzy", similarity.cast("double")))
    return out.otherwise(one("none", 0))


def operation_counts(result: DataFrame, release_rows: int, n_filter: int, n_refine: int) -> DataFrame:
    """One row: what a linkage attack compares and puts out, were it done row by row.

    Each target tests the ``n_filter`` generalized attributes of all released rows, and the ``n_refine`` clear ones of its first candidates.
    """
    per = result.agg(F.count("*").alias("targets_evaluated"), F.coalesce(F.sum("stage1_size"), F.lit(0)).alias("stage1_rows_output"), F.coalesce(F.sum("class_size"), F.lit(0)).alias("class_rows_output"))
    tests = (F.col("targets_evaluated") * release_rows * n_filter).alias("filter_tests"), (F.col("stage1_rows_output") * n_refine).alias("refinement_tests")
    out = per.select("*", *tests)
    return out.withColumn("estimated_total_operations", F.col("filter_tests") + F.col("refinement_tests") + F.col("stage1_rows_output") + F.col("class_rows_output"))


def check_linkage(result: DataFrame) -> None:
    """An error if a target's own record is not among its candidates after the first stage, or a class is larger than them."""
    if not result.filter("stage1_size < 1 or class_size > stage1_size").isEmpty():
        raise ValueError("a target's record is outside its candidates")


def project(targets: DataFrame, hierarchies: Sequence[Hierarchy], levels: dict[str, int]) -> DataFrame:
    """``targets`` with p_<attr>: what each known value looks like in the release."""
    out = with_levels(targets, hierarchies)
    for h in hierarchies:
        out = out.withColumn(f"p_{h.attr}", F.col(f"`levels_{h.attr}`")[min(levels[h.attr], h.levels - 1)])
    return out.drop(*[f"levels_{h.attr}" for h in hierarchies])


def stages(levels: dict[str, int], known: Sequence[str], has_hierarchy: Sequence[str]) -> tuple[list[str], list[str]]:
    """(filter, refine): attributes seen through a hierarchy filter, those in clear refine."""
    first = [a for a in known if a in has_hierarchy and levels.get(a, 0) != 0]
    return first, [a for a in known if a not in first]


@dataclass(frozen=True)
class Fuzzy:
    """Values in clear also match if the similarity of their Bloom encodings reaches the threshold."""

    config: object
    metric: str = "dice"
    threshold: float = 0.8


#: Patterns of suppressed attributes that are joined one by one.
PATTERNS = 64


def _tuple_matches(tuples: DataFrame, release_tuples: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Compatible (target tuple, release tuple): equal, or the release's value is suppressed, in every attribute.

    One equi-join for each pattern of suppressed attributes that the release has; with none, there is one pattern.
    Above ``PATTERNS`` patterns, one equi-join on the pattern and the values that it leaves, of each tuple under each pattern.
    """
    stars = F.concat(*[F.when(is_suppressed(F.col(f"r_{a}")), F.lit("1")).otherwise(F.lit("0")) for a in attrs]) if attrs else F.lit("")
    marked = release_tuples.withColumn("__stars", stars)
    seen = marked.select("__stars").distinct()
    patterns, out = [r[0] for r in seen.limit(PATTERNS + 1).collect()], []
    if len(patterns) > PATTERNS:
        left = lambda side: F.array(*[F.when(F.substring("__stars", i + 1, 1) == "0", F.col(f"{side}_{a}").cast("string")) for i, a in enumerate(attrs)])
        right = marked.withColumn("__left", left("r")).withColumn("n_suppressed", F.length(F.regexp_replace("__stars", "0", "")))
        return tuples.join(F.broadcast(seen)).withColumn("__left", left("p")).join(right, ["__stars", "__left"]).drop("__stars", "__left")
    for p in patterns:
        on = [F.col(f"p_{a}") == F.col(f"r_{a}") for a, s in zip(attrs, p, strict=True) if s == "0"]
        part = marked.filter(F.col("__stars") == p).drop("__stars").withColumn("n_suppressed", F.lit(p.count("1")))
        out.append(tuples.join(part, reduce(lambda a, b: a & b, on)) if on else tuples.join(F.broadcast(part)))
    return reduce(DataFrame.unionByName, out) if out else tuples.join(marked.drop("__stars").withColumn("n_suppressed", F.lit(0)), F.lit(False))


def _release_tuples(release: DataFrame, attrs: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    return release.groupBy(*[F.trim(F.col(f"`{a}`").cast("string")).alias(f"r_{a}") for a in [*attrs, *more]]).agg(F.count("*").alias("rows"))


def stage1(projected: DataFrame, release: DataFrame, id_col: str, attrs: Sequence[str]) -> DataFrame:
    """(id, stage1_size): rows of the release that are compatible with each target; all rows without attributes."""
    if not attrs:
        return projected.select(id_col).join(F.broadcast(release.agg(F.count("*").alias("stage1_size"))))
    looks = [f"p_{a}" for a in attrs]
    tuples = projected.select(*looks).distinct()
    sizes = _tuple_matches(tuples, _release_tuples(release, attrs), attrs).groupBy(*looks).agg(F.sum("rows").alias("stage1_size"))
    return projected.select(id_col, *looks).join(sizes, looks, "left").select(id_col, F.coalesce("stage1_size", F.lit(0)).alias("stage1_size"))


def candidates(projected: DataFrame, release: DataFrame, id_col: str, first: Sequence[str], refine: Sequence[str], sensitive: Sequence[str] = (), fuzzy: Fuzzy | None = None) -> DataFrame:
    """Compatible (target, release tuple) after both stages: id, r_<sensitive>, rows, n_exact_or_general, n_suppressed, n_fuzzy, score_sum."""
    from ..functions.bloom import encode, packed, shared_bits, similarity

    looks = [f"p_{a}" for a in first]
    values = [F.trim(F.col(f"`{a}`").cast("string")).alias(f"p_{a}") for a in refine]
    targets = projected.select(id_col, *looks, *values)
    keys = [*looks, *[f"p_{a}" for a in refine]]
    tuples = targets.select(*keys).distinct()
    rel = _release_tuples(release, [*first, *refine], sensitive)
    if fuzzy is None:
        met = _tuple_matches(tuples, rel, [*first, *refine]).withColumn("n_fuzzy", F.lit(0)).withColumn("score_sum", F.lit(0.0))
    else:
        met = _tuple_matches(tuples, rel, first) if first else tuples.join(F.broadcast(rel.withColumn("n_suppressed", F.lit(0))))
        met = met.withColumn("n_fuzzy", F.lit(0)).withColumn("score_sum", F.lit(0.0))
        for a in refine:
            c = fuzzy.config
            of = lambda df, col: df.select(F.col(col)).distinct().withColumn("w", packed(encode(F.col(col), c), c.size + c.offset))  # noqa: E731, B023
            bits = lambda w: F.aggregate(F.transform(w, F.bit_count), F.lit(0), lambda s, x: s + x)
            left, right = of(tuples, f"p_{a}").withColumnRenamed("w", "wl"), of(rel, f"r_{a}").withColumnRenamed("w", "wr")
            pairs = met.select(f"p_{a}", f"r_{a}").distinct().join(left, f"p_{a}").join(right, f"r_{a}")
            scored = pairs.select(f"p_{a}", f"r_{a}", similarity(fuzzy.metric, shared_bits(F.col("wl"), F.col("wr")), bits(F.col("wl")), bits(F.col("wr")), c.size).alias("__s"))
            same, gone = F.col(f"p_{a}") == F.col(f"r_{a}"), is_suppressed(F.col(f"r_{a}"))
            met = met.join(scored, [f"p_{a}", f"r_{a}"]).filter(same | gone | (F.col("__s") >= fuzzy.threshold))
            by = ~same & ~gone
            met = met.withColumn("n_fuzzy", F.col("n_fuzzy") + by.cast("int")).withColumn("score_sum", F.col("score_sum") + F.when(by, F.col("__s")).otherwise(0.0)).withColumn("n_suppressed", F.col("n_suppressed") + (~same & gone).cast("int")).drop("__s")
    return targets.join(met, keys).select(id_col, *[f"r_{s}" for s in sensitive], "rows", (F.lit(len(keys)) - F.col("n_suppressed") - F.col("n_fuzzy")).alias("n_equal"), "n_suppressed", "n_fuzzy", "score_sum")


def sensitive_guess(found: DataFrame, id_col: str, sensitive: str) -> DataFrame:
    """For each target with candidates: class_size, n_sensitive, predicted (most frequent, then smallest), probability, certain, distribution (JSON)."""
    per = found.groupBy(id_col, F.col(f"r_{sensitive}").alias("v")).agg(F.sum("rows").alias("n"))
    entry = F.struct((-F.col("n")).alias("o"), F.col("v"), F.col("n"))
    out = per.groupBy(id_col).agg(F.sum("n").alias("class_size"), F.count("*").alias("n_sensitive"), F.sort_array(F.collect_list(entry)).alias("all"))
    share = F.transform("all", lambda x: F.struct(x["v"].alias("key"), (x["n"] / F.col("class_size")).alias("value")))
    return out.select(id_col, "class_size", "n_sensitive", F.col("all")[0]["v"].alias("predicted"), (F.col("all")[0]["n"] / F.col("class_size")).alias("probability"), (F.col("n_sensitive") == 1).alias("certain"), F.to_json(F.map_from_entries(share)).alias("distribution"))


def linkage_attack(targets: DataFrame, release: DataFrame, truth: DataFrame, id_col: str, known: Sequence[str], sensitive: str, hierarchies: Sequence[Hierarchy], levels: dict[str, int], fuzzy: Fuzzy | None = None) -> DataFrame:
    """One row per target: stage1_size, class_size, reduction, reidentified, guesses, and whether they are right.

    targets: id and known values; release: public columns (no id); truth: id and sensitive value of each released row.
    Fails if a target is not in the release.
    """
    missing = targets.join(truth.select(id_col), id_col, "left_anti")
    if not missing.isEmpty():
        raise ValueError("a target is not in the release")
    own = [h for h in hierarchies if h.attr in known]
    first, refine = stages(levels, known, [h.attr for h in own])
    projected = project(targets, [h for h in own if h.attr in first], levels)
    s1 = stage1(projected, release, id_col, first)
    found = candidates(projected, release, id_col, first, refine, [sensitive], fuzzy)
    guess = sensitive_guess(found, id_col, sensitive)
    real = truth.select(id_col, F.col(f"`{sensitive}`").cast("string").alias("true_value"))
    per = found.join(real, id_col).groupBy(id_col).agg(F.sum(F.when(F.col(f"r_{sensitive}") == F.col("true_value"), F.col("rows")).otherwise(0)).alias("hits"))
    out = s1.join(guess, id_col, "left").join(real, id_col).join(per, id_col, "left")
    size = F.coalesce("class_size", F.lit(0))
    return out.select(
        id_col, "stage1_size", size.alias("class_size"), (F.col("stage1_size") - size).alias("reduction"), F.when(F.col("stage1_size") > 0, (F.col("stage1_size") - size) / F.col("stage1_size")).otherwise(0.0).alias("reduction_rate"),
        ((size == 1) & (F.col("hits") > 0)).alias("reidentified"), ((size == 1) & (F.coalesce("hits", F.lit(0)) == 0)).alias("false_unique"), "true_value", "predicted", "probability",
        F.coalesce(F.col("predicted") == F.col("true_value"), F.lit(False)).alias("guess_right"), F.coalesce("certain", F.lit(False)).alias("certain"), F.coalesce("n_sensitive", F.lit(0)).alias("n_sensitive"),
        F.when(size > 0, F.coalesce("hits", F.lit(0)) / size).otherwise(0.0).alias("true_probability"), "distribution",
    )


def linkage_summary(result: DataFrame) -> DataFrame:
    rate = lambda c: F.bround(F.avg(F.col(c).cast("double")), 6)
    return result.agg(
        F.count("*").alias("n_targets"), rate("reidentified").alias("reidentification_rate"), rate("false_unique").alias("false_unique_rate"), rate("stage1_size").alias("avg_stage1_size"), rate("class_size").alias("avg_class_size"),
        F.bround(F.median("class_size"), 6).alias("median_class_size"), F.max("class_size").alias("max_class_size"), rate("reduction_rate").alias("avg_reduction_rate"), rate("certain").alias("certainty_rate"), rate("guess_right").alias("guess_accuracy"), rate("true_probability").alias("avg_true_probability"),
    )


def sensitive_report(result: DataFrame) -> DataFrame:
    """For each true value: targets, share, right guesses and their rate, mean and median probability, certainty."""
    total = result.agg(F.count("*").alias("total"))
    per = result.groupBy("true_value").agg(F.count("*").alias("n"), F.sum(F.col("guess_right").cast("long")).alias("n_right"), F.avg("true_probability").alias("mean_probability"), F.median("true_probability").alias("median_probability"), F.avg(F.col("certain").cast("double")).alias("certainty_rate"))
    return per.join(F.broadcast(total)).select("true_value", "n", (F.col("n") / F.col("total")).alias("share"), "n_right", (F.col("n_right") / F.col("n")).alias("accuracy"), "mean_probability", "median_probability", "certainty_rate")


def membership_attack(targets: DataFrame, release: DataFrame, id_col: str, known: Sequence[str], hierarchies: Sequence[Hierarchy], levels: dict[str, int], most: float | None = 0.09, fuzzy: Fuzzy | None = None) -> DataFrame:
    """One row per target (id, known values, is_member): candidate_count, candidate_fraction, predicted.

    A target is called a member if it has candidates and they are at most the share ``most`` of the release (None: any share).
    """
    own = [h for h in hierarchies if h.attr in known]
    first, refine = stages(levels, known, [h.attr for h in own])
    projected = project(targets, [h for h in own if h.attr in first], levels)
    found = candidates(projected, release, id_col, first, refine, [], fuzzy).groupBy(id_col).agg(F.sum("rows").alias("candidate_count"))
    n = release.agg(F.count("*").alias("n"))
    out = targets.select(id_col, "is_member").join(found, id_col, "left").join(F.broadcast(n))
    count = F.coalesce("candidate_count", F.lit(0))
    fraction = F.when(F.col("n") > 0, count / F.col("n")).otherwise(0.0)
    called = (count > 0) & (F.lit(True) if most is None else fraction <= most)
    return out.select(id_col, "is_member", count.alias("candidate_count"), fraction.alias("candidate_fraction"), called.cast("int").alias("predicted"))


def binary_metrics(decided: DataFrame, truth: str = "is_member", called: str = "predicted") -> DataFrame:
    """One row: tp, tn, fp, fn and rates; 0 where a denominator is 0. advantage is accuracy - 0.5."""
    t, p = F.col(truth) == 1, F.col(called) == 1
    c = decided.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    safe = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    rates = {"accuracy": safe(tp + tn, tp + tn + fp + fn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "tnr": safe(tn, tn + fp), "fpr": safe(fp, fp + tn), "fnr": safe(fn, fn + tp)}
    f1 = safe(2 * rates["precision"] * rates["recall"], rates["precision"] + rates["recall"])
    return c.select("tp", "tn", "fp", "fn", *[F.round(e, 6).alias(n) for n, e in rates.items()], F.round(f1, 6).alias("f1"), F.round(rates["accuracy"] - 0.5, 6).alias("advantage"))


def best_threshold(decided: DataFrame) -> DataFrame:
    """One row: the fraction at and below which calling a member is right most often (the smallest such), and its accuracy.

    Thresholds are all fractions, and a little below the least and above the largest. Counted per distinct fraction.
    """
    hit = (F.col("candidate_count") > 0).cast("long")
    per = decided.groupBy(F.col("candidate_fraction").alias("f")).agg(F.sum(hit * F.when(F.col("is_member") == 1, 1).otherwise(-1)).alias("gain"), F.sum(1 - F.col("is_member").cast("long")).alias("outs"), F.count("*").alias("n"))
    total = per.agg(F.sum("outs").alias("base"), F.sum("n").alias("total"), F.min("f").alias("lo"))
    curve = running(per.select("f", "gain"), [F.col("f")], {"upto": F.col("gain")}).select("f", F.col("upto").alias("gain"))
    points = curve.join(F.broadcast(total)).select("f", (F.col("base") + F.col("gain")).alias("right"), "total").unionByName(total.select((F.col("lo") - 1e-12).alias("f"), F.col("base").alias("right"), "total"))
    return points.agg(F.max(F.struct("right", (-F.col("f")).alias("f"), "total")).alias("x")).select((-F.col("x.f")).alias("threshold"), (F.col("x.right") / F.col("x.total")).alias("accuracy"))


def ks_two_sample(decided: DataFrame, value: str = "candidate_fraction", group: str = "is_member") -> DataFrame:
    """One row: the largest distance of the two empirical distributions, and its asymptotic p-value."""
    per = decided.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == 1).alias("a"), F.count_if(F.col(group) != 1).alias("b"))
    total = per.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    d = running(per, [F.col("v")], {"ca": F.col("a"), "cb": F.col("b")}).select("ca", "cb").join(F.broadcast(total)).agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    z = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("ks")
    terms = reduce(lambda a, b: a + b, [2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * z * z) for k in range(1, 101)])
    return d.select("ks", F.when(z < 0.05, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms))).alias("p_value"))


def group_means(decided: DataFrame) -> DataFrame:
    """Mean candidate counts and fractions of members and others."""
    of = lambda c, m: F.avg(F.when(F.col("is_member") == m, F.col(c)))
    return decided.agg(*[of(c, m).alias(f"{n}_avg_{c}") for (m, n), c in itertools.product(((1, "member"), (0, "non_member")), ("candidate_count", "candidate_fraction"))])
