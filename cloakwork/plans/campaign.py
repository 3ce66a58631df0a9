"""Campaigns: grids of experiments, releases that several attacks share, attacker profiles, the phase curve."""

from __future__ import annotations

import traceback
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import attack_id, experiment_id, qi_subsets, random_configurations
from ..operators import attacks, quality, reporting, sampling
from ..operators.anonymize import AGGREGATES, MEASURES, Model, Roles, anonymize, best_node, frequencies
from ..operators.hierarchy import Hierarchy
from ..sources.scratch import written


@dataclass(frozen=True)
class Experiment:
    qis: tuple[str, ...]
    model: Model = field(default_factory=Model)
    measure: str = "loss"
    aggregate: str = "geometric_mean"

    @property
    def id(self) -> str:
        m = self.model
        return experiment_id(self.qis, m.k, m.l, m.t, m.suppression_limit, self.measure, self.aggregate)


def grid(pool: Sequence[str], sizes: Iterable[int], ks: Iterable[int] = (5,), ls: Iterable[int] = (2,), ts: Iterable[float | None] = (None,), limits: Iterable[float] = (0.1,), measures: Iterable[str] = ("loss",), aggregates: Iterable[str] = ("geometric_mean",)) -> list[Experiment]:
    """All combinations, in a fixed order; unknown measures and aggregates are errors."""
    measures, aggregates, ks, ls, ts, limits = (list(x) for x in (measures, aggregates, ks, ls, ts, limits))
    if bad := [x for x in measures if x not in MEASURES] + [x for x in aggregates if x not in AGGREGATES]:
        raise ValueError(f"unknown: {bad}")
    return [Experiment(q, Model(k, l, t, s), m, a) for q in qi_subsets(pool, sizes) for k in ks for l in ls for t in ts for s in limits for m in measures for a in aggregates]


def run_grid(df: DataFrame, hierarchies: Sequence[Hierarchy], sensitive: str, experiments: Sequence[Experiment], stop_on_error: bool = False) -> DataFrame:
    """One row per experiment: its parameters, status, node and figures. The frequency table of each set of quasi-identifiers is counted once."""
    counted, rows = {}, []
    for e in experiments:
        row = {"experiment_id": e.id, "qis": ",".join(e.qis), "k": e.model.k, "l": e.model.l, "measure": e.measure, "aggregate": e.aggregate, "status": "success", "node": None, "score": None, "n_classes": None, "n_suppressed": None, "error": None}
        try:
            if e.qis not in counted:
                counted[e.qis] = frequencies(df, [h for h in hierarchies if h.attr in e.qis], sensitive)
            found = best_node(counted[e.qis], e.model, e.measure, e.aggregate)
            if found is None:
                row["status"] = "infeasible"
            else:
                score = found["score"][0] if isinstance(found["score"], list) else found["score"]
                row |= {"node": ",".join(f"{a}={l}" for a, l in found["node"].items()), "score": float(score), "n_classes": found["n_classes"], "n_suppressed": found["n_suppressed"]}
        except Exception:
            if stop_on_error:
                raise
            row |= {"status": "failed", "error": traceback.format_exc()[-500:]}
        rows.append(row)
    schema = "experiment_id string, qis string, k int, l int, measure string, aggregate string, status string, node string, score double, n_classes long, n_suppressed long, error string"
    return df.sparkSession.createDataFrame(rows, schema)


@dataclass(frozen=True)
class Attacker:
    """A profile: what the attacker knows of each target."""

    name: str
    known: tuple[str, ...]


def profiles(columns: Sequence[str], sensitive: Sequence[str], steps: Sequence[int]) -> list[Attacker]:
    """Attackers who know more and more of the columns, and one who knows all but the sensitive ones."""
    open_ = [c for c in columns if c not in sensitive]
    return [*[Attacker(f"A{i + 1}", tuple(open_[:n])) for i, n in enumerate(steps)], Attacker(f"A{len(steps) + 1}", tuple(open_))]


def attack_campaign(df: DataFrame, id_col: str, sensitive: str, hierarchies: Sequence[Hierarchy], experiments: Sequence[Experiment | None], attackers: Sequence[Attacker], n_targets: int, seed: int = 42) -> DataFrame:
    """One row per release and attacker: linkage and membership figures. None as an experiment is the unchanged table.

    A tenth of the rows is held out of every release; releases that several runs share are made once.
    """
    spark = df.sparkSession
    out_size = max(1, df.count() // 10)
    published, held = (written(x, "split") for x in sampling.split(df, id_col, out_size, seed))
    releases: dict[str, tuple[DataFrame, dict[str, int]]] = {}
    rows = []
    for e in experiments:
        key = e.id if e else "baseline"
        if key not in releases:
            if e is None:
                releases[key] = written(published.withColumn("suppressed", F.lit(False)), "release"), {}
            else:
                release, found = anonymize(published, Roles(e.qis, (sensitive,)), hierarchies, e.model, e.measure, e.aggregate)
                releases[key] = written(release, "release"), found["node"]
        release, node = releases[key]
        public = release.filter(~F.col("suppressed"))
        for a in attackers:
            base = sampling.auxiliary_base(df, public, id_col, a.known, n_targets, seed)
            visible = {h.attr: node.get(h.attr, 0) for h in hierarchies}
            linked = attacks.linkage_summary(attacks.linkage_attack(base, public.drop(id_col), public.select(id_col, sensitive), id_col, a.known, sensitive, hierarchies, visible)).first()
            targets = sampling.membership_targets(published, held, public, id_col, a.known, seed)
            told = attacks.binary_metrics(attacks.membership_attack(targets, public.drop(id_col), id_col, a.known, hierarchies, visible)).first()
            rows.append((key, attack_id(key, a.known), a.name, ",".join(a.known), *(float(x or 0) for x in (linked["reidentification_rate"], linked["avg_stage1_size"], linked["avg_class_size"], linked["guess_accuracy"], told["accuracy"], told["advantage"]))))
    return spark.createDataFrame(rows, "release string, attack_id string, attacker string, known string, reidentification_rate double, avg_stage1_size double, avg_class_size double, guess_accuracy double, mia_accuracy double, mia_advantage double")


def phase_curve(df: DataFrame, id_col: str, sensitive: str, hierarchies: Sequence[Hierarchy], known: Sequence[str], n_configs: int, n_targets: int, model: Model, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(runs, curve): random sets of generalized attributes, and class sizes by how many known attributes are generalized."""
    pool = [h.attr for h in hierarchies]
    rows = []
    for qis, _ in random_configurations(pool, n_configs, 1, len(pool), seed):
        release, found = anonymize(df, Roles(qis, (sensitive,)), hierarchies, model)
        release = written(release, "release").filter(~F.col("suppressed"))
        base = sampling.auxiliary_base(df, release, id_col, known, n_targets, seed)
        levels = {h.attr: found["node"].get(h.attr, 0) for h in hierarchies}
        s = attacks.linkage_summary(attacks.linkage_attack(base, release.drop(id_col), release.select(id_col, sensitive), id_col, known, sensitive, hierarchies, levels)).first()
        rows.append((",".join(qis), sum(levels.get(a, 0) > 0 for a in known), float(s["avg_stage1_size"]), float(s["median_class_size"])))
    runs = df.sparkSession.createDataFrame(rows, "qis string, n_generalized int, stage1 double, stage2 double")
    return runs, reporting.group_statistics(runs, ["n_generalized"], "stage2")


def release_report(raw: DataFrame, release: DataFrame, id_col: str, hierarchies: Sequence[Hierarchy], node: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(one row about the classes, one row per attribute)."""
    return quality.class_statistics(release, [h.attr for h in hierarchies]), quality.attribute_metrics(raw, release, id_col, hierarchies, node)


def with_model(e: Experiment, **changes) -> Experiment:
    return replace(e, model=replace(e.model, **changes))


def session(name: str = "cloakwork") -> SparkSession:
    """A session with the settings that the engine's plans expect."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
