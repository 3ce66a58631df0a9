"""The command line: ``python -m cloakwork COMMAND ...``. Tables are CSV, or Parquet if their name ends so; results are Parquet, pages HTML."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import attacks, sampling, schema_match
from .operators.anonymize import AGGREGATES, MEASURES, Model, Roles, anonymize
from .operators.hierarchy import Hierarchy, by_table
from .plans import benchmarks, reports
from .plans.campaign import session
from .sources.files import hierarchy_files, read_hierarchy, save_json


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _pairs(text: str, kind=str) -> dict:
    return {k: kind(v) for k, v in (x.split("=", 1) for x in _names(text))}


def _hierarchies(spark: SparkSession, folder: str | None, attrs: Sequence[str]) -> list[Hierarchy]:
    files = hierarchy_files(folder, attrs) if folder else {}
    return [by_table(a, read_hierarchy(spark, p, a)) for a, p in files.items() if benchmarks.path_exists(spark, p)]


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _page(text: str, path: str | None) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def run_anonymize(spark, a) -> None:
    df = benchmarks.read_any(spark, a.input)
    roles = Roles(tuple(a.qis), tuple(a.sensitive), tuple(a.identifiers))
    release, found = anonymize(df, roles, _hierarchies(spark, a.hierarchies, a.qis), Model(a.k, a.l, a.t, a.suppression), a.measure, a.aggregate)
    _written(release, a.output)
    if a.metrics:
        save_json(found, a.metrics)


def run_auxiliary(spark, a) -> None:
    df, release = benchmarks.read_any(spark, a.input), benchmarks.read_any(spark, a.release)
    n = sampling.subset_size(df.count(), a.size, a.share)
    _written(sampling.auxiliary_base(df, release, a.id, a.known, n, a.seed), a.output)


def run_split(spark, a) -> None:
    df = benchmarks.read_any(spark, a.input)
    sampling.require_unique(df, a.id)
    published, out = sampling.split(df, a.id, sampling.held_out_size(df.count(), a.size, a.share), a.seed)
    published, out = _written(published, f"{a.output}/published.parquet"), _written(out, f"{a.output}/out.parquet")
    if a.metadata:
        save_json(sampling.split_record(published, out, a.id, a.seed, None, f"{a.output}/published.parquet")[0], a.metadata)


def run_targets(spark, a) -> None:
    published, out, release = (benchmarks.read_any(spark, x) for x in (a.published, a.out, a.release))
    targets = _written(sampling.membership_targets(published, out, release, a.id, a.known, a.seed), a.output)
    if a.metadata:
        save_json(sampling.release_figures(published, release, targets, a.id).first(), a.metadata)


def run_link(spark, a) -> None:
    targets, release = benchmarks.read_any(spark, a.targets), benchmarks.read_any(spark, a.release)
    known = attacks.known_attributes(targets, a.id, a.known)
    levels = attacks.with_suppressed_columns(a.levels, release, known)
    truth = benchmarks.read_any(spark, a.truth).select(a.id, a.sensitive)
    found = attacks.linkage_attack(targets, release.drop(a.id), truth, a.id, known, a.sensitive, _hierarchies(spark, a.hierarchies, known), levels)
    found = _written(found, a.output)
    attacks.check_linkage(found)
    _page(reports.linkage_page(found) if a.page else "", a.page)


def run_member(spark, a) -> None:
    targets, release = benchmarks.read_any(spark, a.targets), benchmarks.read_any(spark, a.release)
    known = attacks.known_attributes(targets, a.id, a.known)
    found = _written(attacks.membership_attack(targets, release.drop(a.id), a.id, known, _hierarchies(spark, a.hierarchies, known), a.levels, a.most), a.output)
    _page(reports.membership_page(found) if a.page else "", a.page)


def run_utility(spark, a) -> None:
    _written(benchmarks.utility_benchmark(spark, benchmarks.read_any(spark, a.input), a.releases, a.qis, a.sensitive, a.output, not a.again), f"{a.output}/_runs")


def run_classify(spark, a) -> None:
    runs = _written(benchmarks.classification_benchmark(spark, a.releases, a.id, a.features, a.target, a.output, a.models, a.folds, not a.again), f"{a.output}/_runs")
    _page(reports.classification_page(benchmarks.results(runs)) if a.page else "", a.page)


def run_match_schema(spark, a) -> None:
    unknown, known = benchmarks.read_any(spark, a.unknown), benchmarks.read_any(spark, a.known_table)
    _written(schema_match.recover(unknown, known, unknown.columns, known.columns, a.matcher, a.min_score), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cloakwork")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *required: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        return c

    c = command("anonymize", run_anonymize, "input", "output")
    c.add_argument("--qis", type=_names, required=True)
    c.add_argument("--sensitive", type=_names, default=[])
    c.add_argument("--identifiers", type=_names, default=[])
    c.add_argument("--hierarchies", required=True)
    c.add_argument("--k", type=int, default=5)
    c.add_argument("--l", type=int, default=1)
    c.add_argument("--t", type=float)
    c.add_argument("--suppression", type=float, default=0.1)
    c.add_argument("--measure", choices=MEASURES, default="loss")
    c.add_argument("--aggregate", choices=AGGREGATES, default="geometric_mean")
    c.add_argument("--metrics")
    c = command("auxiliary", run_auxiliary, "input", "release", "output", "id")
    c.add_argument("--known", type=_names, required=True)
    c = command("split", run_split, "input", "output", "id")
    c = command("targets", run_targets, "published", "out", "release", "output", "id")
    c.add_argument("--known", type=_names, required=True)
    for name in ("auxiliary", "split"):
        commands.choices[name].add_argument("--size", type=int)
        commands.choices[name].add_argument("--share", type=float)
    for name in ("auxiliary", "split", "targets"):
        commands.choices[name].add_argument("--seed", type=int, default=42)
    for name in ("split", "targets"):
        commands.choices[name].add_argument("--metadata")
    c = command("link", run_link, "targets", "release", "truth", "output", "id", "sensitive")
    c = command("member", run_member, "targets", "release", "output", "id")
    c.add_argument("--most", type=float, default=0.09)
    for name in ("link", "member"):
        commands.choices[name].add_argument("--known", type=_names, default=[])
        commands.choices[name].add_argument("--hierarchies")
        commands.choices[name].add_argument("--levels", type=lambda x: _pairs(x, int), default={})
        commands.choices[name].add_argument("--page")
    c = command("utility", run_utility, "input", "output")
    c.add_argument("--qis", type=_names, required=True)
    c.add_argument("--sensitive", type=_names, default=[])
    c = command("classify", run_classify, "output", "id", "target")
    c.add_argument("--features", type=_names, required=True)
    c.add_argument("--models", type=_names, default=["naive_bayes"])
    c.add_argument("--folds", type=int, default=5)
    c.add_argument("--page")
    for name in ("utility", "classify"):
        commands.choices[name].add_argument("--releases", type=_pairs, required=True, help="name=path,...")
        commands.choices[name].add_argument("--again", action="store_true", help="also where a result is there")
    c = command("match-schema", run_match_schema, "unknown", "known-table", "output")
    c.add_argument("--matcher", default="jaccard_baseline")
    c.add_argument("--min-score", type=float, default=0.0)
    return p


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(spark or session(), a)
