"""Meta-blocking: weights of the pairs that share blocks, and pruning of the weighted pairs.

The pair table is one join of the (side, id, key) table with itself on the key and one aggregation;
all weights are expressions over the counts that it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...sources.scratch import written
from ..ranges import ranked, running
from .encode import expanded

SCHEMES = ("CBS", "CN-CBS", "SN-CBS", "CNC", "SNC", "CND", "SND", "CNJ", "SNJ", "COSINE", "DICE", "ECBS", "JS", "EJS", "X2")


def pair_table(blocks: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(id1, id2, c, cn, sn, l1, l2, d1, d2, blocks, pairs) of all pairs that share a key.

    c: shared keys; cn, sn: shared keys weighed by 1 / (n1 * n2) and 1 / (n1 + n2) of the key; l: keys of a record;
    d: distinct neighbours of a record; blocks: all keys; pairs: all pairs. Where ``blocks`` are those of classes (side, id, n) of
    records with the same keys, all numbers are still of records, and m1 and m2 are the numbers of records of both classes.
    """
    b = blocks.distinct()
    b = written(b.withColumn("n", F.lit(1).cast("long")) if classes is None else b.join(classes.select("side", "id", "n"), ["side", "id"]), "blocks")
    on = lambda s: F.sum(F.when(F.col("side") == s - 1, F.col("n")).otherwise(0)).alias(f"n{s}")
    per_key = b.groupBy("key").agg(on(1), on(2))
    n_blocks = per_key.agg(F.count("*").alias("blocks"))
    per_key = per_key.filter("n1 > 0 and n2 > 0")
    a = b.filter("side = 0").join(per_key, "key").select("key", F.col("id").alias("id1"), "n1", "n2", F.col("n").alias("m1"))
    z = b.filter("side = 1").select("key", F.col("id").alias("id2"), F.col("n").alias("m2"))
    n1, n2 = F.col("n1"), F.col("n2")
    edges = written(a.join(z, "key").groupBy("id1", "id2", "m1", "m2").agg(F.count("*").alias("c"), F.sum(1 / (n1 * n2)).alias("cn"), F.sum(1 / (n1 + n2)).alias("sn")), "edges")
    keys_of = lambda s: b.filter(F.col("side") == s).groupBy(F.col("id").alias(f"id{s + 1}")).agg(F.count("*").alias(f"l{s + 1}"))
    degree = lambda s: edges.groupBy(f"id{s}").agg(F.sum(f"m{3 - s}").alias(f"d{s}"))
    total = edges.agg(F.sum(F.col("m1") * F.col("m2")).alias("pairs")).join(n_blocks)
    return edges.join(keys_of(0), "id1").join(keys_of(1), "id2").join(degree(1), "id1").join(degree(2), "id2").join(F.broadcast(total))


def weight(scheme: str) -> Column:
    """A weighting scheme over the columns of ``pair_table``."""
    c, l1, l2, d1, d2 = (F.col(x).cast("double") for x in ("c", "l1", "l2", "d1", "d2"))
    b, e = F.col("blocks").cast("double"), F.col("pairs") / 2.0
    shared = {"C": F.col("cn"), "S": F.col("sn")}
    if scheme in ("CNC", "SNC", "CND", "SND", "CNJ", "SNJ"):
        s = shared[scheme[0]]
        return {"C": s / F.sqrt(d1 * d2), "D": 2 * s / (d1 + d2), "J": F.when(F.abs(d1 + d2 - s) > 1e-9, s / (d1 + d2 - s)).otherwise(0.0)}[scheme[2]]
    js = c / (l1 + l2 - c)
    bottom = l1 * l2 * (b - l1) * (b - l2)
    table = {
        "CBS": c, "CN-CBS": shared["C"], "SN-CBS": shared["S"], "COSINE": c / F.sqrt(l1 * l2), "DICE": 2 * c / (l1 + l2), "JS": js, "ECBS": c * F.log10(b / l1) * F.log10(b / l2),
        "EJS": js * F.log10(e / d1) * F.log10(e / d2), "X2": F.when(bottom != 0, b * F.pow(c * b - l1 * l2, 2) / bottom).otherwise(0.0),
    }
    if scheme not in table:
        raise ValueError(f"unknown weighting scheme: {scheme}")
    return table[scheme]


def weighted(pairs: DataFrame, scheme: str, *rest: str) -> DataFrame:
    """(id1, id2, weight) and the columns ``rest``."""
    return pairs.select("id1", "id2", weight(scheme).cast("double").alias("weight"), *rest)


def _copies(edges: DataFrame, *sides: int) -> Column:
    """The number of records, or of their pairs, that a row of a pair of classes stands for; 1 without m1 and m2."""
    return reduce(lambda a, b: a * b, [F.col(f"m{s}") if f"m{s}" in edges.columns else F.lit(1) for s in sides])


def _mean(edges: DataFrame, *sides: int) -> Column:
    n = _copies(edges, *sides)
    return F.sum(F.col("weight") * n) / F.sum(n)


def wep(edges: DataFrame) -> DataFrame:
    """Weighted edge pruning: weights at or above the mean of all pairs, and not 0."""
    mean = edges.agg(_mean(edges, 1, 2).alias("t"))
    return edges.join(F.broadcast(mean)).filter("weight >= t and weight <> 0").select("id1", "id2", "weight")


def cep(edges: DataFrame, assignments: int) -> DataFrame:
    """Cardinality edge pruning: the assignments // 2 largest weights; ties by ids."""
    order = [F.col("weight").desc(), F.col("id1"), F.col("id2")]
    return ranked(edges.filter("weight <> 0"), order, "rank").filter(F.col("rank") < assignments // 2).drop("rank")


def cep_classes(edges: DataFrame, assignments: int, members: DataFrame) -> DataFrame:
    """``cep`` of the records of classes: pairs are counted by weight, and only those of the weight at the cut are put in order."""
    own, most = edges.filter("weight <> 0").select("id1", "id2", "weight", "m1", "m2"), assignments // 2
    levels = running(own.groupBy("weight").agg(F.sum(_copies(own, 1, 2)).alias("n")), [F.col("weight").desc()], {"upto": F.col("n")})
    cut = levels.filter(F.col("upto") > most).orderBy(F.col("weight").desc()).limit(1).first()
    if cut is None:
        return expanded(own.select("id1", "id2", "weight"), members)
    rest = most - (cut["upto"] - cut["n"])
    at = written(own.filter(F.col("weight") == cut["weight"]), "cut")
    firsts = members.filter("side = 0").join(at.groupBy(F.col("id1").alias("class")).agg(F.sum("m2").alias("pairs")), "class")
    firsts = written(running(firsts, [F.col("id")], {"upto": F.col("pairs")}), "cut")
    whole = firsts.filter(F.col("upto") <= rest).select("side", "id", "class", "n").unionByName(members.filter("side = 1").select("side", "id", "class", "n"))
    out = expanded(own.filter(F.col("weight") > cut["weight"]).select("id1", "id2", "weight"), members).unionByName(expanded(at.select("id1", "id2", "weight"), whole))
    part = firsts.filter((F.col("upto") > rest) & (F.col("upto") - F.col("pairs") < rest)).first()
    if part is not None:
        others = at.filter(F.col("id1") == part["class"]).select(F.col("id2").alias("class"), "weight").join(members.filter("side = 1"), "class")
        out = out.unionByName(others.orderBy("id").limit(rest - (part["upto"] - part["pairs"])).select(F.lit(part["id"]).cast("long").alias("id1"), F.col("id").alias("id2"), "weight"))
    return out


def cnp_classes(edges: DataFrame, k: int, members: DataFrame, reciprocal: bool = False) -> DataFrame:
    """``cnp`` of the records of classes. All records of a class have the same k best: k classes at most, of each its k first records."""
    own = edges.filter("weight <> 0").select("id1", "id2", "weight")
    place = Window.partitionBy("side", "class").orderBy("id")
    low = written(members.select("side", "class", "id", F.row_number().over(place).alias("k")).filter(F.col("k") <= k).drop("k"), "low")

    def best(s: int) -> DataFrame:
        """(id1, id2, weight, best<s>): classes, and the records of the other class that are among the k best."""
        one, two = f"id{s}", f"id{3 - s}"
        near = own.withColumn("k", F.row_number().over(Window.partitionBy(one).orderBy(F.col("weight").desc(), two))).filter(F.col("k") <= k).drop("k")
        near = near.join(low.filter(F.col("side") == 2 - s).select(F.col("class").alias(two), "id"), two)
        near = near.withColumn("k", F.row_number().over(Window.partitionBy(one).orderBy(F.col("weight").desc(), "id"))).filter(F.col("k") <= k)
        return written(near.groupBy("id1", "id2", "weight").agg(F.collect_list("id").alias(f"best{s}")), "best")

    a, b = best(1), best(2)
    if reciprocal:
        both = a.join(b, ["id1", "id2", "weight"]).select(F.explode("best2").alias("id1"), "best1", "weight")
        return both.select("id1", F.explode("best1").alias("id2"), "weight")
    of = lambda s: members.filter(F.col("side") == s - 1).select(F.col("class").alias(f"id{s}"), F.col("id").alias(f"r{s}"))
    first = a.join(of(1), "id1").select(F.col("r1").alias("id1"), F.explode("best1").alias("id2"), "weight")
    more = b.join(a, ["id1", "id2", "weight"], "left").join(of(2), "id2").filter("best1 is null or not array_contains(best1, r2)")
    return first.unionByName(more.select(F.explode("best2").alias("id1"), F.col("r2").alias("id2"), "weight"))


def node_k(assignments: int, entities: int) -> int:
    return max(1, assignments // max(entities, 1))


def _ranks(edges: DataFrame) -> DataFrame:
    by = lambda a, b: Window.partitionBy(a).orderBy(F.col("weight").desc(), b)
    return edges.filter("weight <> 0").withColumn("k1", F.row_number().over(by("id1", "id2"))).withColumn("k2", F.row_number().over(by("id2", "id1")))


def cnp(edges: DataFrame, k: int, reciprocal: bool = False) -> DataFrame:
    """Cardinality node pruning: among the k best of either end (``reciprocal``: of both); ties by ids."""
    both = (F.col("k1") <= k, F.col("k2") <= k)
    return _ranks(edges).filter(both[0] & both[1] if reciprocal else both[0] | both[1]).select("id1", "id2", "weight")


def _per_node(edges: DataFrame, agg) -> DataFrame:
    one = lambda s: edges.groupBy(f"id{s}").agg(agg(s).alias(f"t{s}"))
    return edges.join(one(1), "id1").join(one(2), "id2")


def wnp(edges: DataFrame, reciprocal: bool = False) -> DataFrame:
    """Weighted node pruning: at or above the mean weight of either end (``reciprocal``: of both), and above 0."""
    w, (t1, t2) = F.col("weight"), (F.col("weight") >= F.col("t1"), F.col("weight") >= F.col("t2"))
    return _per_node(edges, lambda s: _mean(edges, 3 - s)).filter((w > 0) & (t1 & t2 if reciprocal else t1 | t2)).select("id1", "id2", "weight")


def blast(edges: DataFrame) -> DataFrame:
    """At or above a quarter of the sum of both ends' largest weights, and above 0."""
    return _per_node(edges, lambda s: F.max("weight")).filter("weight > 0 and weight >= (t1 + t2) / 4").select("id1", "id2", "weight")


def prune(pairs: DataFrame, method: str, scheme: str | None = None, assignments: int = 0, entities: int = 0, legacy: bool = False) -> DataFrame:
    """Any pruning method with its default scheme. legacy: RCNP as CNP, RWNP and BLAST as WNP."""
    defaults = {"WEP": "CBS", "CEP": "JS", "CNP": "CBS", "RCNP": "CN-CBS", "WNP": "CBS", "RWNP": "CN-CBS", "BLAST": "X2"}
    if method not in defaults:
        raise ValueError(f"unknown pruning method: {method}")
    edges = weighted(pairs, scheme or defaults[method])
    if method == "WEP":
        return wep(edges)
    if method == "CEP":
        return cep(edges, assignments)
    if method in ("CNP", "RCNP"):
        return cnp(edges, node_k(assignments, entities), method == "RCNP" and not legacy)
    return blast(edges) if method == "BLAST" and not legacy else wnp(edges, method == "RWNP" and not legacy)
