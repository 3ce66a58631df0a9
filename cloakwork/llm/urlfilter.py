"""URL rules by their rarest literal token, in DataFrame functions only.

A rule has a host and a path prefix; it fits its host and all subdomains of it. Every rule is
indexed under one literal token, the one that the fewest distinct URLs hold; the tokens of a URL
fetch its candidate rules, and only those run their regular expression. The longest rule that
fits decides (of equally long ones ``block``, then the smaller text).

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
there up to ``?``, ``#`` or the end. A null URL or one without ``://`` has both empty and no rule.
URLs that no rule fits get the default verdict. Rows that repeat stay; null ids stay. A rule with an empty path fits all
paths of its hosts. Only the id and the URL are read, so other columns' names can clash with nothing; URLs of any length are taken whole.

The index is as long as the rule list. Up to ``broadcast_rules`` rules it is broadcast (a rule
is a short string, so that bounds its size); a longer list is joined by a shuffle, in which the
rows of each token are dealt over ``salts`` parts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, host, path prefix); fixed by the contract of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(target: Column) -> Column:
    """Runs of letters and digits, each once."""
    return F.array_distinct(F.filter(F.split(target, "[^A-Za-z0-9]+"), lambda x: x != ""))


def rule_tokens(host: str, path: str) -> list[str]:
    """Tokens that every URL of the rule holds whole: not a last one that can go on."""
    found = re.findall(r"[A-Za-z0-9]+", host) + re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return sorted(set(found))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = 100_000, salts: int = 32) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (host and path of the deciding rule, or null), verdict."""
    spark = pages.sparkSession
    for verdict, host, _ in rules:
        if verdict not in ("allow", "block") or not re.search("[A-Za-z0-9]", host):
            raise ValueError(f"not a rule: {verdict} {host}")
    parsed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = written(parsed.select("host", "path").distinct(), "op8-urls")
    held = urls.select("host", "path", F.explode(tokens_of(F.concat_ws("/", "host", "path"))).alias("token"))
    listed = spark.createDataFrame(
        [(v, h.lower() + p, rf"\A(?:[^/]*\.)?{re.escape(h.lower())}(?=/|\z){re.escape(p)}", rule_tokens(h.lower(), p)) for v, h, p in rules],
        "verdict string, rule string, pattern string, tokens array<string>",
    )
    small = len(rules) <= broadcast_rules
    may = F.broadcast if small else (lambda x: x)
    of_rules = listed.select("rule", "verdict", "pattern", F.explode("tokens").alias("token"))
    counts = held.join(may(of_rules.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("held"))
    rare = of_rules.join(counts, "token", "left").groupBy("rule", "verdict", "pattern").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token"))["token"].alias("token"))
    if small:
        met = held.join(F.broadcast(rare), "token")
    else:
        dealt = rare.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = held.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")).join(dealt, ["token", "salt"])
    fits = met.filter(F.expr("concat(host, path) rlike pattern"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("l"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("v"), "rule", "verdict")).alias("best"))
    out = parsed.join(best.select("host", "path", "best.rule", "best.verdict"), ["host", "path"], "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


URL_SQL = r"""
    WITH p AS (SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
        FROM pages),
    r(verdict, h, f) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    d AS (SELECT DISTINCT host, path FROM p),
    m AS (SELECT host, path, h || f AS rule, verdict,
            row_number() OVER (PARTITION BY host, path ORDER BY length(h || f) DESC, verdict DESC, h || f) AS k
        FROM d, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f))
    SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
    FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path AND m.k = 1"""
