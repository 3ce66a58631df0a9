"""Full-domain anonymization: privacy models, suppression, and the search for the best node of the lattice.

The search never touches rows again once they are counted: one aggregation makes the frequency
table of distinct (quasi-identifier values, sensitive value); nodes of the lattice are evaluated on that
table, a batch of nodes a job, in the order of a lower bound of their score (the score without any
suppression, which needs the frequencies of single attributes only). The search ends when no
node left can beat the best one found.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import ratio
from ..sources.scratch import written
from .hierarchy import Hierarchy, generalize, with_levels

#: Nodes that one job evaluates, and the most that a lattice may have.
BATCH, MAX_NODES = 64, 1_000_000
MEASURES = ("loss", "height", "precision", "nm_entropy", "entropy", "discernibility", "aecs", "ambiguity", "classification")
PER_ATTRIBUTE = ("loss", "height", "precision", "nm_entropy")
AGGREGATES = ("arithmetic_mean", "geometric_mean", "sum", "maximum", "rank")


@dataclass(frozen=True)
class Roles:
    """What each column is; identifiers are never released."""

    quasi_identifiers: tuple[str, ...]
    sensitive: tuple[str, ...] = ()
    identifiers: tuple[str, ...] = ()
    insensitive: tuple[str, ...] = ()


@dataclass(frozen=True)
class Model:
    """k-anonymity, distinct l-diversity, t-closeness (total variation), and the share of rows that may be suppressed (above 1: percent)."""

    k: int = 2
    l: int = 1
    t: float | None = None
    suppression_limit: float = 0.0


def classes(df: DataFrame, qis: Sequence[str], sensitive: str | None = None) -> DataFrame:
    """Equivalence classes: the quasi-identifiers, class_size and n_sensitive (distinct values)."""
    keys = [F.col(f"`{q}`") for q in qis]
    if sensitive is None:
        return df.groupBy(*keys).agg(F.count("*").alias("class_size"))
    per = df.groupBy(*keys, F.col(f"`{sensitive}`").alias("__s")).agg(F.count("*").alias("__n"))
    return per.groupBy(*keys).agg(F.sum("__n").alias("class_size"), F.count("__s").alias("n_sensitive"))


def closeness(df: DataFrame, qis: Sequence[str], sensitive: str) -> DataFrame:
    """For each class the total variation distance between its sensitive values and all rows' (``t_distance``).

    Half the sum of |p - q| over the values in the class, and of q over those that it lacks: no cross product.
    """
    keys = [F.col(f"`{q}`") for q in qis]
    s = F.col(f"`{sensitive}`").alias("__s")
    own = df.groupBy(*keys, s).agg(F.count("*").alias("__n"))
    overall = df.groupBy(s).agg(F.count("*").alias("__all"))
    total = overall.agg(F.sum("__all").alias("__total"))
    share = overall.join(F.broadcast(total)).select(F.col("__s").alias("__v"), (F.col("__all") / F.col("__total")).alias("__q"))
    sizes = own.groupBy(*keys).agg(F.sum("__n").alias("class_size"))
    j = own.join(share, own["__s"].eqNullSafe(share["__v"])).join(sizes.select(*[F.col(f"`{q}`").alias(f"__k{i}") for i, q in enumerate(qis)], "class_size"), _same(qis))
    p = F.col("__n") / F.col("class_size")
    return j.groupBy(*keys, "class_size").agg((0.5 * (F.sum(F.abs(p - F.col("__q"))) + 1 - F.sum("__q"))).alias("t_distance"))


def _same(qis: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, q in enumerate(qis):
        out = out & F.col(f"`{q}`").eqNullSafe(F.col(f"__k{i}"))
    return out


def failing(df: DataFrame, qis: Sequence[str], model: Model, sensitive: str | None) -> DataFrame:
    """The classes that break the model: quasi-identifiers as __k0, __k1, ..."""
    sized = classes(df, qis, sensitive if model.l > 1 else None)
    bad = F.col("class_size") < model.k
    if model.l > 1:
        bad = bad | (F.col("n_sensitive") < model.l)
    names = [F.col(f"`{q}`").alias(f"__k{i}") for i, q in enumerate(qis)]
    out = sized.filter(bad).select(*names)
    if model.t is not None:
        out = out.unionByName(closeness(df, qis, sensitive).filter(F.col("t_distance") > model.t + 1e-12).select(*names)).distinct()
    return out


def suppress(df: DataFrame, qis: Sequence[str], model: Model, sensitive: str | None = None) -> DataFrame:
    """Rows of failing classes get ``*`` in all quasi-identifiers; a column ``suppressed`` tells."""
    bad = failing(df, qis, model, sensitive).withColumn("__bad", F.lit(True))
    j = df.join(bad, _same(qis), "left")
    gone = F.coalesce(F.col("__bad"), F.lit(False))
    keep = [F.when(gone, F.lit("*")).otherwise(F.col(f"`{c}`").cast("string")).alias(c) if c in qis else F.col(f"`{c}`") for c in df.columns]
    return j.select(*keep, gone.alias("suppressed"))


def aggregate(name: str, values: Sequence[float], weights: Sequence[float] | None = None) -> float | list[float]:
    """Per-attribute scores in one; ``rank`` gives the scores in falling order, compared one by one."""
    v = [x * w for x, w in zip(values, weights or [1.0] * len(values), strict=True)]
    if name == "arithmetic_mean":
        return sum(v) / len(v)
    if name == "geometric_mean":
        return math.prod(1 + x for x in v) ** (1 / len(v)) - 1
    if name == "sum":
        return sum(v)
    if name == "maximum":
        return max(v)
    if name == "rank":
        return sorted(v, reverse=True)
    raise ValueError(f"unknown aggregate: {name}")


@dataclass
class Frequencies:
    """The counted microdata that a search works on."""

    table: DataFrame
    hierarchies: Sequence[Hierarchy]
    rows: int
    #: For each attribute and level: mean loss, mean non-uniform entropy (bits), per row.
    loss: dict[str, list[float]] = field(default_factory=dict)
    entropy: dict[str, list[float]] = field(default_factory=dict)
    #: The table with the numbers of leaves of all labels, and the sizes of the domains, once something asks for them.
    leaves: tuple[DataFrame, list[int]] | None = None


def frequencies(df: DataFrame, hierarchies: Sequence[Hierarchy], sensitive: str | None) -> Frequencies:
    """Distinct (levels of each attribute, sensitive) with counts, and for each attribute the losses of its labels.

    An attribute's domain is its table's leaves, or the values that occur if its levels are expressions.
    """
    names = [h.attr for h in hierarchies]
    s = F.col(f"`{sensitive}`") if sensitive else F.lit(None).cast("string")
    leveled = with_levels(df, hierarchies).select(s.alias("__s"), *[F.col(f"`levels_{n}`") for n in names])
    counted = leveled.groupBy("__s", *[F.col(f"`levels_{n}`") for n in names]).agg(F.count("*").alias("n"))
    table = written(counted, "frequencies")
    out = Frequencies(table, hierarchies, table.agg(F.sum("n")).first()[0] or 0)
    for h in hierarchies:
        labels = f"levels_{h.attr}"
        per_leaf = table.groupBy(F.col(f"`{labels}`").alias("ls")).agg(F.sum("n").alias("n"))
        leaves = h.table.select(F.col("levels").alias("ls")).distinct() if h.table is not None else per_leaf.select("ls")
        domain = leaves.count()
        size = leaves.select(F.posexplode("ls").alias("level", "label")).groupBy("level", "label").agg(F.count("*").alias("leaves"))
        seen = per_leaf.select("n", F.col("ls")[0].alias("leaf"), F.posexplode("ls").alias("level", "label"))
        mass = seen.groupBy("level", "label").agg(F.sum("n").alias("mass"))
        j = seen.join(mass, ["level", "label"]).join(size, ["level", "label"], "left")
        lost = F.sum(F.col("n") * (F.coalesce("leaves", F.lit(1)) - 1)) / F.lit(float(max(domain - 1, 1)))
        got = {r["level"]: r for r in j.groupBy("level").agg(lost.alias("loss"), F.sum(-F.col("n") * F.log2(F.col("n") / F.col("mass"))).alias("entropy")).collect()}
        out.loss[h.attr] = [got[i]["loss"] / out.rows if i in got else 0.0 for i in range(h.levels)]
        out.entropy[h.attr] = [got[i]["entropy"] / out.rows if i in got else 0.0 for i in range(h.levels)]
    return out


def lattice(hierarchies: Sequence[Hierarchy]) -> list[tuple[int, ...]]:
    if math.prod(h.levels for h in hierarchies) > MAX_NODES:
        raise ValueError(f"the lattice has more than {MAX_NODES} nodes")
    return list(itertools.product(*[range(h.levels) for h in hierarchies]))


def _released(cls: DataFrame, per: DataFrame, freq: Frequencies, model: Model, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The classes with what the model needs to know of them, and whether it lets a class be released."""
    ok = (F.col("size") >= model.k) & (F.col("kinds") >= model.l if model.l > 1 else F.lit(True))
    if model.t is None:
        return cls, ok
    total = freq.table.groupBy("__s").agg((F.sum("n") / freq.rows).alias("q"))
    dist = per.join(total.select(F.col("__s").alias("__v"), "q"), F.col("__s").eqNullSafe(F.col("__v"))).join(cls.select("node", *keys, "size"), ["node", *keys])
    dist = dist.groupBy("node", *keys).agg((0.5 * (F.sum(F.abs(F.col("n") / F.col("size") - F.col("q"))) + 1 - F.sum("q"))).alias("d"))
    return cls.join(dist, ["node", *keys]), ok & (F.col("d") <= model.t + 1e-12)


def scan(freq: Frequencies, nodes: Sequence[tuple[int, ...]], model: Model) -> DataFrame:
    """One row per node: classes kept, rows suppressed, sizes, sum of squared sizes, rows not in their class's majority, ..."""
    names = [h.attr for h in freq.hierarchies]
    listed = F.array(*[F.struct(F.lit(i).alias("node"), *[F.lit(l).alias(f"l{j}") for j, l in enumerate(n)]) for i, n in enumerate(nodes)])
    spread = freq.table.withColumn("x", F.explode(listed))
    gen = [F.element_at(F.col(f"`levels_{n}`"), F.col(f"x.l{j}") + 1).alias(f"g{j}") for j, n in enumerate(names)]
    keys = [f"g{j}" for j in range(len(names))]
    per = spread.select("__s", "n", F.col("x.node").alias("node"), *gen)
    per = per.groupBy("node", *keys, "__s").agg(F.sum("n").alias("n"))
    cls = per.groupBy("node", *keys).agg(F.sum("n").alias("size"), F.count("__s").alias("kinds"), F.max("n").alias("major"))
    cls, ok = _released(cls, per, freq, model, keys)
    size = F.col("size")
    kept = lambda x: F.coalesce(F.sum(F.when(ok, x)), F.lit(0))
    return cls.groupBy("node").agg(
        F.count_if(ok).alias("n_classes"), kept(size).cast("long").alias("n_released"), (F.sum(size) - kept(size)).cast("long").alias("n_suppressed"),
        F.min(F.when(ok, size)).alias("min_size"), F.max(F.when(ok, size)).alias("max_size"), kept(size * size).cast("long").alias("sum_squares"),
        kept(size - F.col("major")).cast("long").alias("minority"), kept(size * F.log2(size.cast("double"))).alias("size_log"),
    )



def _with_leaves(freq: Frequencies) -> tuple[DataFrame, list[int]]:
    """The frequency table with leaves<j>, the number of leaves of each level's label, and the sizes of the domains; made once."""
    if freq.leaves is None:
        table, domains = freq.table, []
        for j, h in enumerate(freq.hierarchies):
            labels = f"levels_{h.attr}"
            own = (h.table.select(F.col("levels").alias("ls")) if h.table is not None else table.select(F.col(f"`{labels}`").alias("ls"))).distinct()
            domains.append(own.count())
            size = own.select(F.posexplode("ls").alias("level", "label")).groupBy("level", "label").agg(F.count("*").alias("leaves"))
            of = own.select("ls", F.posexplode("ls").alias("level", "label")).join(size, ["level", "label"]).groupBy("ls").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "leaves"))), lambda r: r["leaves"]).alias(f"leaves{j}"))
            table = table.join(of.withColumnRenamed("ls", f"ls{j}"), F.col(f"`{labels}`") == F.col(f"ls{j}"), "left").drop(f"ls{j}")
        freq.leaves = written(table, "leaves"), domains
    return freq.leaves


def _per_class(freq: Frequencies, nodes: Sequence[tuple[int, ...]], model: Model, values) -> tuple[DataFrame, Column, int]:
    """The classes of all nodes with the sums a0, a1, ... over their rows of what ``values`` makes of the label's leaves, a list of columns."""
    names = [h.attr for h in freq.hierarchies]
    table, domains = _with_leaves(freq)
    listed = F.array(*[F.struct(F.lit(i).alias("node"), *[F.lit(l).alias(f"l{j}") for j, l in enumerate(n)]) for i, n in enumerate(nodes)])
    spread = table.withColumn("x", F.explode(listed))
    keys = [f"g{j}" for j in range(len(names))]
    gen = [F.element_at(F.col(f"`levels_{n}`"), F.col(f"x.l{j}") + 1).alias(f"g{j}") for j, n in enumerate(names)]
    found = values([F.coalesce(F.element_at(f"leaves{j}", F.col(f"x.l{j}") + 1), F.lit(1)) for j in range(len(names))], domains)
    per = spread.select("__s", "n", F.col("x.node").alias("node"), *gen, *[v.alias(f"a{i}") for i, v in enumerate(found)])
    sums = range(len(found))
    per = per.groupBy("node", *keys, "__s").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"a{i}")).alias(f"a{i}") for i in sums])
    cls = per.groupBy("node", *keys).agg(F.sum("n").alias("size"), F.count("__s").alias("kinds"), *[F.sum(f"a{i}").alias(f"a{i}") for i in sums])
    return *_released(cls, per, freq, model, keys), len(found)


def losses(freq: Frequencies, nodes: Sequence[tuple[int, ...]], model: Model) -> dict[int, list[float]]:
    """For each node the exact mean loss of each attribute where suppressed rows lose 1."""
    cls, ok, n = _per_class(freq, nodes, model, lambda leaves, domains: [(x - 1) / F.lit(float(max(d - 1, 1))) for x, d in zip(leaves, domains, strict=True)])
    sums = [F.sum(F.when(ok, F.col(f"a{i}")).otherwise(F.col("size"))).alias(f"a{i}") for i in range(n)]
    return {r["node"]: [r[f"a{i}"] / freq.rows for i in range(n)] for r in cls.groupBy("node").agg(*sums).collect()}


def ambiguities(freq: Frequencies, nodes: Sequence[tuple[int, ...]], model: Model) -> dict[int, float]:
    """For each node the mean number of original combinations that a row's labels allow; a suppressed row allows all."""
    product = lambda values: math.prod(values[1:], start=values[0])
    cls, ok, _ = _per_class(freq, nodes, model, lambda leaves, domains: [product([x.cast("double") for x in leaves])])
    every = F.col("size") * float(math.prod(_with_leaves(freq)[1]))
    return {r["node"]: r["a0"] / freq.rows for r in cls.groupBy("node").agg(F.sum(F.when(ok, F.col("a0")).otherwise(every)).alias("a0")).collect()}


def bound(freq: Frequencies, node: Sequence[int], measure: str) -> list[float]:
    """Per-attribute scores of a node without suppression; lower is better."""
    out = []
    for h, level in zip(freq.hierarchies, node, strict=True):
        top = max(h.levels - 1, 1)
        out.append({"loss": freq.loss[h.attr][level], "height": float(level), "precision": level / top, "nm_entropy": freq.entropy[h.attr][level]}[measure])
    return out


def best_node(freq: Frequencies, model: Model, measure: str = "loss", aggregate_by: str = "geometric_mean", weights: Sequence[float] | None = None, batch: int = BATCH) -> dict | None:
    """The feasible node with the lowest score: node, score, and the columns of ``scan``. Ties: lower levels first.

    None if no node keeps the rows that must be suppressed within the limit.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure: {measure}")
    single = measure in PER_ATTRIBUTE
    score0 = (lambda n: aggregate(aggregate_by, bound(freq, n, measure), weights)) if single else (lambda n: 0.0)
    order = sorted(lattice(freq.hierarchies), key=lambda n: (score0(n), n))
    allowed, best = ratio(model.suppression_limit) * freq.rows, None
    for at in range(0, len(order), batch):
        nodes = order[at : at + batch]
        if best is not None and single and score0(nodes[0]) > best["score"]:
            break
        found = [r.asDict() for r in scan(freq, nodes, model).collect()]
        fits = [r for r in found if r["n_suppressed"] <= allowed + 1e-9]
        exact = {"loss": losses, "ambiguity": ambiguities}[measure](freq, [nodes[r["node"]] for r in fits], model) if measure in ("loss", "ambiguity") and fits else {}
        for i, r in enumerate(fits):
            node = nodes[r["node"]]
            if measure == "loss":
                score = aggregate(aggregate_by, exact[i], weights)
            elif measure == "ambiguity":
                score = exact[i]
            elif single:
                score = score0(node)
            else:
                score = _whole(measure, r, freq)
            one = r | {"node": dict(zip([h.attr for h in freq.hierarchies], node, strict=True)), "score": score, "levels": node}
            if best is None or (score, node) < (best["score"], best["levels"]):
                best = one
    return best


def _whole(measure: str, r: dict, freq: Frequencies) -> float:
    n = max(freq.rows, 1)
    if measure == "discernibility":
        return r["sum_squares"] + r["n_suppressed"] * n
    if measure == "aecs":
        return n / r["n_classes"] if r["n_classes"] else float("inf")
    if measure == "classification":
        return (r["minority"] + r["n_suppressed"]) / n
    return (r["size_log"] + r["n_suppressed"] * math.log2(n)) / n  # entropy


def anonymize(df: DataFrame, roles: Roles, hierarchies: Sequence[Hierarchy], model: Model, measure: str = "loss", aggregate_by: str = "geometric_mean", weights: Sequence[float] | None = None) -> tuple[DataFrame, dict]:
    """The release (identifiers dropped, a column ``suppressed``) of the best node, and that node."""
    sensitive = roles.sensitive[0] if roles.sensitive else None
    own = [h for h in hierarchies if h.attr in roles.quasi_identifiers]
    found = best_node(frequencies(df, own, sensitive), model, measure, aggregate_by, weights)
    if found is None:
        raise ValueError("no node meets the model within the suppression limit")
    public = generalize(df.drop(*roles.identifiers), own, found["node"])
    return suppress(public, [h.attr for h in own], model, sensitive), found
