"""String expressions: suppressed values, interval midpoints, tokens, q-grams, identifiers."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_suppressed(c: Column) -> Column:
    """Empty or stars only, after trimming; null counts as suppressed."""
    return F.coalesce(F.trim(c.cast("string")).rlike(r"^\**$"), F.lit(True))


def parse_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def range_midpoint(c: Column) -> Column:
    """A number as itself, ``lo-hi`` (hyphen or en dash, no signs) as its middle, all else null."""
    s = F.trim(c.cast("string"))
    # a fixed value: the form of intervals that releases use
    span = r"^(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)$"
    low, high = (F.regexp_extract(s, span, i).try_cast("double") for i in (1, 2))
    plain = F.when(~F.lower(s).isin("nan", "*", "?", ""), s.try_cast("double"))
    return F.coalesce(plain, (low + high) / 2)


def tokens(c: Column) -> Column:
    """Distinct lower-cased runs of letters and digits (Unicode; an underscore parts words too)."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)[\W_]+"), lambda x: x != ""))


def qgrams(token: Column, q: int) -> Column:
    """The windows of q characters; a shorter token is padded with underscores."""
    padded = F.when(F.length(token) < q, F.rpad(token, q, "_")).otherwise(token)
    return F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, F.lit(q)))


def every_second(token: Column, odd: bool) -> Column:
    """The characters at odd (second, fourth, ...) or even positions."""
    return F.array_join(F.filter(F.split(token, ""), lambda x, i: (i % 2 == (1 if odd else 0)) & (x != "")), "")


def json_values_mean(c: Column) -> Column:
    """The mean of the numbers of a flat JSON object."""
    values = F.filter(F.map_values(F.from_json(c, "map<string,double>")), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def digest8(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:8]


def experiment_id(qis: Sequence[str], k: int, l: int, t: float | None, limit: float, measure: str, aggregate: str | None) -> str:
    """Our own identifiers, in a payload of our own."""
    return "run_" + digest8(f"qi={','.join(qis)};k={k};l={l};t={t};supp={limit};measure={measure};agg={aggregate}")


def attack_id(release: str, known: Sequence[str], kind: str = "known") -> str:
    return f"{release}__{kind}_{digest8('-'.join(known))}"


def qi_subsets(pool: Sequence[str], sizes: Iterable[int]) -> Iterator[tuple[str, ...]]:
    """All subsets of the sizes, in the order of the pool."""
    for n in sizes:
        yield from itertools.combinations(pool, n)


def random_configurations(pool: Sequence[str], n: int, least: int, most: int, seed: int) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """n different (quasi-identifiers, other attributes) draws; fewer if there are not as many."""
    rng, found = random.Random(seed), []
    possible = sum(1 for _ in qi_subsets(pool, range(least, most + 1)))
    while len(found) < min(n, possible):
        qis = tuple(sorted(rng.sample(list(pool), rng.randint(least, most)), key=pool.index))
        one = (qis, tuple(a for a in pool if a not in qis))
        if one not in found:
            found.append(one)
    return found
