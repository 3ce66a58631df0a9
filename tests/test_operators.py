import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import anonymize as A
from cloakwork.operators import attacks, classify, quality, reporting, sampling, schema_match, utility
from cloakwork.operators.hierarchy import Hierarchy, band, by_expression, generalize
from cloakwork.functions.bloom import BloomConfig
from cloakwork.operators.pprl import block, cluster, encode, evaluate, metablock
from cloakwork.sources import scratch


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(17, 90), rng.choice("MF"), rng.choice(["a", "b", "c"])) for i in range(400)]
    return spark.createDataFrame(rows, "id long, age int, sex string, illness string")


@pytest.fixture(scope="module")
def hierarchies():
    return [Hierarchy("age", exprs=(lambda c: c, band(5), band(20), lambda c: F.lit("*"))), by_expression("sex")]


MODEL = A.Model(5, 2, None, 0.1)


def test_release_is_anonymous(people, hierarchies):
    release, found = A.anonymize(people, A.Roles(("age", "sex"), ("illness",)), hierarchies, MODEL)
    kept = A.classes(release.filter(~F.col("suppressed")), ["age", "sex"], "illness").agg(F.min("class_size"), F.min("n_sensitive")).first()
    assert kept[0] >= 5 and kept[1] >= 2
    assert release.filter("suppressed").count() == found["n_suppressed"] <= 40
    assert release.filter("suppressed and (age <> '*' or sex <> '*')").count() == 0


def test_best_node_is_best(people, hierarchies):
    freq = A.frequencies(people, hierarchies, "illness")
    best = A.best_node(freq, MODEL)
    nodes = A.lattice(hierarchies)
    scan = {r["node"]: r for r in A.scan(freq, nodes, MODEL).collect()}
    fits = [i for i, r in scan.items() if r["n_suppressed"] <= 40]
    lost = A.losses(freq, [nodes[i] for i in fits], MODEL)
    assert min(A.aggregate("geometric_mean", lost[k]) for k in lost) == pytest.approx(best["score"])
    assert A.best_node(freq, MODEL, batch=2)["levels"] == best["levels"]
    assert A.best_node(freq, A.Model(10_000, 1, None, 0.0)) is None


def test_every_measure_finds_a_node(people, hierarchies):
    freq = A.frequencies(people, hierarchies, "illness")
    for measure in A.MEASURES:
        assert A.best_node(freq, MODEL, measure)["n_suppressed"] <= 40


def test_t_closeness(people, hierarchies):
    d = A.closeness(generalize(people, hierarchies, {"age": 2, "sex": 1}), ["age", "sex"], "illness").collect()
    assert all(0 <= r["t_distance"] <= 1 for r in d) and len(d) >= 4
    one = A.closeness(generalize(people, hierarchies, {"age": 3, "sex": 1}), ["age", "sex"], "illness").first()
    assert one["t_distance"] == pytest.approx(0)


def test_quality(people, hierarchies):
    release = A.suppress(generalize(people, hierarchies, {"age": 0, "sex": 0}), ["age", "sex"], A.Model(1), None)
    m = {r["attribute"]: r for r in quality.attribute_metrics(people, release, "id", hierarchies, {"age": 0, "sex": 0}).collect()}
    assert m["age"]["granularity"] == pytest.approx(1) and m["age"]["generalization_intensity"] == 1 and m["age"]["nu_entropy"] == pytest.approx(1)
    s = quality.class_statistics(release, ["age", "sex"]).first()
    assert s["n_rows"] == 400 and s["n_suppressed"] == 0


def test_utility_of_itself(people):
    d = utility.divergences(people, people, "age").first()
    assert d["kl_divergence"] == pytest.approx(0) and d["tvd"] == pytest.approx(0)
    assert utility.wasserstein(people, people.withColumn("age", F.col("age") + 2), "age").first()[0] == pytest.approx(2)
    assert utility.correlation_delta(people, people, ["age", "sex"]).first()["frobenius"] == pytest.approx(0)


def test_linkage_and_membership(spark, people, hierarchies):
    release = generalize(people, hierarchies, {"age": 2, "sex": 0})
    targets = people.select("id", "age", "sex").filter("id < 50")
    r = attacks.linkage_attack(targets, release.drop("id"), release.select("id", "illness"), "id", ["age", "sex"], "illness", hierarchies, {"age": 2, "sex": 0}).collect()
    rows = {x["id"]: x for x in people.collect()}
    age = lambda a: a // 20
    for x in r:
        me = rows[x["id"]]
        first = [p for p in rows.values() if age(p["age"]) == age(me["age"])]
        both = [p for p in first if p["sex"] == me["sex"]]
        assert (x["stage1_size"], x["class_size"]) == (len(first), len(both))
        assert x["true_probability"] == pytest.approx(sum(p["illness"] == me["illness"] for p in both) / len(both))
    t = targets.withColumn("is_member", F.lit(1)).unionByName(spark.createDataFrame([(999, 5, "X", 0)], "id long, age int, sex string, is_member int"))
    d = {x["id"]: x for x in attacks.membership_attack(t, release.drop("id"), "id", ["age", "sex"], hierarchies, {"age": 2, "sex": 0}, None).collect()}
    assert d[999]["candidate_count"] == 0 and d[999]["predicted"] == 0 and d[3]["predicted"] == 1
    with pytest.raises(ValueError):
        attacks.linkage_attack(targets.unionByName(spark.createDataFrame([(999, 5, "M")], "id long, age int, sex string")), release.drop("id"), release.select("id", "illness"), "id", ["age"], "illness", hierarchies, {"age": 2})


def test_suppressed_values_stay_compatible(spark):
    targets = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, p string, q string")
    release = spark.createDataFrame([("a", "x"), ("*", "y"), ("*", "*")], "p string, q string")
    found = attacks.membership_attack(targets.withColumn("is_member", F.lit(1)), release, "id", ["p", "q"], [], {}, None)
    assert {r["id"]: r["candidate_count"] for r in found.collect()} == {1: 2, 2: 2}


def test_fuzzy_refinement(spark):
    from cloakwork.functions.bloom import BloomConfig

    targets = spark.createDataFrame([(1, "johnathan", 1)], "id long, name string, is_member int")
    release = spark.createDataFrame([("jonathan",), ("peter",), ("*",)], "name string")
    fuzzy = attacks.Fuzzy(BloomConfig(1024, 4, kind="qgrams", q=2), "dice", 0.6)
    assert attacks.membership_attack(targets, release, "id", ["name"], [], {}, None, fuzzy).first()["candidate_count"] == 2


def test_metrics_with_empty_denominators(spark):
    d = spark.createDataFrame([(1, 0, 0, 0.0)], "is_member int, predicted int, candidate_count long, candidate_fraction double")
    m = attacks.binary_metrics(d).first()
    assert (m["tp"], m["fn"], m["precision"], m["f1"]) == (0, 1, 0.0, 0.0)


def test_splits(people):
    published, out = sampling.split(people, "id", 40)
    assert published.count() == 360 and out.count() == 40 and published.join(out, "id").count() == 0
    with pytest.raises(ValueError):
        sampling.membership_targets(published, out, people, "id", ["age"])
    numbered = sampling.with_record_id(people.drop("id"), ["age", "sex", "illness"])
    sampling.require_unique(numbered, "record_id")
    assert {int(r[0]) for r in numbered.select("record_id").collect()} == set(range(400))
    assert sampling.subset_size(10, share=0.25) == 2


def blocks(spark):
    keys = {(0, 0): "ab", (0, 1): "bcd", (1, 2): "ab", (1, 3): "cde"}
    return spark.createDataFrame([(s, i, k) for (s, i), ks in keys.items() for k in ks], "side int, id long, key string")


def test_metablocking_toy(spark):
    p = metablock.pair_table(blocks(spark))
    known = {
        (0, 2): (2, 1.5, 0.833333, 1.06066, 0.555556, 0.384615, 1.0, 1.0, 1.0, 0.316713, -0.022001, 5.0),
        (1, 2): (1, 0.5, 0.333333, 0.25, 0.166667, 0.090909, 0.408248, 0.4, 0.25, 0.088282, 0.003902, 0.138889),
        (1, 3): (2, 2.0, 1.0, 1.414214, 0.666667, 0.5, 0.666667, 0.666667, 0.5, 0.098434, -0.011, 0.138889),
    }
    names = ("CBS", "CN-CBS", "SN-CBS", "CNC", "SND", "SNJ", "COSINE", "DICE", "JS", "ECBS", "EJS", "X2")
    got = p.select("id1", "id2", *[metablock.weight(n).cast("double").alias(n) for n in names]).collect()
    for r in got:
        assert [r[n] for n in names] == pytest.approx(known[r["id1"], r["id2"]], abs=2e-6)
    ids = lambda df: {(r["id1"], r["id2"]) for r in df.collect()}
    assert ids(metablock.prune(p, "WEP")) == {(0, 2), (1, 3)}
    assert ids(metablock.prune(p, "CEP", assignments=10)) == ids(metablock.prune(p, "CNP", assignments=10, entities=4)) == set(known)
    assert ids(metablock.prune(p, "RWNP", "CBS")) <= ids(metablock.prune(p, "RWNP", "CBS", legacy=True))
    with pytest.raises(ValueError):
        metablock.prune(p, "XYZ")


def greedy(edges):
    a, b, out = set(), set(), set()
    for i, j, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
            out.add((i, j))
    return out


def test_unique_mapping_is_greedy(spark):
    rng = random.Random(2)
    for n in (4, 12):
        edges = [(i, j, rng.randint(1, 5) / 5) for i, j in itertools.product(range(n), range(n)) if rng.random() < 0.5]
        df = spark.createDataFrame(edges, "id1 long, id2 long, weight double")
        assert {(r["id1"], r["id2"]) for r in cluster.unique_mapping(df).collect()} == greedy([e for e in edges if e[2] > 0.1])


def test_components_and_isolated(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (1, 2, 1.0), (5, 5, 1.0)], "id1 long, id2 long, weight double")
    got = {(r["side"], r["id"]): r["cluster_id"] for r in cluster.components(df).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 2): 0, (0, 5): 10, (1, 5): 10}
    assert [(r["id1"], r["id2"]) for r in cluster.isolated_edges(df).collect()] == [(5, 5)]


def test_center_clusters(spark):
    df = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (1, 1, 0.7)], "id1 long, id2 long, weight double")
    kept = {(r["id1"], r["id2"]) for r in cluster.center_edges(df).collect()}
    # averages: left 0 has 0.85, right 0 has 0.9, so left 0 is the center of (0, 0); right 1 joins it; then no center meets left 1
    assert kept == {(0, 0), (0, 1)}


def centers_one_by_one(edges, threshold):
    """The kept pairs, in one pass by falling weight."""
    own = sorted((e for e in edges if e[2] > threshold), key=lambda e: (-e[2], e[0], e[1]))
    mean = lambda side, i: sum(ws := [e[2] for e in own if e[side] == i]) / len(ws)
    is_center, kept = {}, set()
    for i, j, _ in own:
        ends = ((0, i), (1, j))
        free = [n for n in ends if n not in is_center]
        if len(free) == 2:
            is_center[ends[0]] = mean(0, i) < mean(1, j)
            is_center[ends[1]] = not is_center[ends[0]]
            kept.add((i, j))
        elif len(free) == 1 and any(is_center.get(n) for n in ends):
            is_center[free[0]] = False
            kept.add((i, j))
    return kept


def test_center_rounds_equal_one_pass(spark):
    import random

    rng = random.Random(4)
    for size in (4, 9):
        edges = sorted({(rng.randrange(size), rng.randrange(size)) for _ in range(3 * size)})
        edges = [(i, j, rng.choice([0.4, 0.6, 0.7, 0.8, 0.9])) for i, j in edges]
        df = spark.createDataFrame(edges, "id1 long, id2 long, weight double")
        assert {(r["id1"], r["id2"]) for r in cluster.center_edges(df).collect()} == centers_one_by_one(edges, 0.5)
    assert cluster.center_edges(df.limit(0)).count() == 0


def test_joint_weights_without_other_keys(spark):
    rows = [(s, 1, k) for s in (0, 1) for k in ("x", "y")]
    pairs = metablock.pair_table(spark.createDataFrame(rows, "side int, id long, key string"))
    # both degrees are 1 and two keys are shared: 1 + 1 - 2 = 0
    assert metablock.weighted(pairs, "CNJ").first()["weight"] == 0 and metablock.weighted(pairs, "SNJ").first()["weight"] == 1


def test_evaluation(spark):
    truth = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "id1 long, id2 long")
    pairs = spark.createDataFrame([(0, 0, 0.9), (1, 2, 0.8), (2, 2, 0.7)], "id1 long, id2 long, weight double")
    s = evaluate.pair_scores(pairs, truth, 3, 3).first()
    assert (s["true_positives"], s["false_positives"], s["false_negatives"], s["true_negatives"]) == (2, 1, 1, 5)
    assert evaluate.pair_scores(pairs.limit(0), truth).first()["f1"] == 0
    assert [r["recall"] for r in evaluate.recall_curve(pairs, truth).orderBy("pos").collect()] == pytest.approx([1 / 3, 1 / 3, 2 / 3])


def test_blockers_check_their_arguments(spark):
    enc = spark.createDataFrame([(s, i, [i % 4]) for s in (0, 1) for i in range(3)], "side int, id long, bits_a array<int>")
    for bad in (dict(psi=0, lam=0), dict(size=6), dict(attrs=["zzz"]), dict(psi=99)):
        with pytest.raises(ValueError):
            block.bit_blocks(enc, **({"size": 4, "psi": 2, "lam": 2} | bad)).count()
    found = block.candidate_pairs(block.bit_blocks(enc, 4, 4, 1)).collect()
    assert {(r["id1"], r["id2"]) for r in found} == {(0, 0), (1, 1), (2, 2)}


def test_schema_matching(spark, people):
    unknown, truth = schema_match.obfuscate(people.select("sex", "illness"), ["sex", "illness"])
    for matcher in ("jaccard_baseline", "instances", "jaccard"):
        m = schema_match.recover(unknown, people, list(truth), ["sex", "illness", "age"], matcher, 0.1)
        e = schema_match.evaluate_mapping(m, spark.createDataFrame(list(truth.items()), "unknown string, known string")).first()
        assert (e["coverage"], e["recall"]) == (1.0, 1.0), matcher


def test_classification(spark):
    rows = [(i, "x" if i % 2 else "y", float(i % 7), "p" if i % 2 else "q") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, kind string, n double, label0 string")
    got = classify.out_of_fold(df, "id", ["kind", "n"], "label0", "naive_bayes", 2)
    assert got.count() == 60 and got.filter("truth = predicted").count() > 55
    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "truth int, score double")
    assert classify.auc(scored).first()["auc"] == pytest.approx(0.875)
    assert classify.zero_r(df, "label0").filter("predicted").count() == 1


def test_reports(spark, people):
    assert reporting.histogram(people, "age", 7).agg(F.sum("n")).first()[0] == 400
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [(r["bin"], r["n"]) for r in reporting.histogram(flat, "v").collect()] == [(0, 2)]
    assert "<table>" in reporting.html_table(people.limit(2), "x & y")


def test_models_have_all_their_trees_and_iterations(spark):
    made = {name: make(100) for name, (_, make) in classify.models().items()}
    assert made["random_forest"].getNumTrees() == 500 and made["logistic_regression"].getMaxIter() == 2000
    made = {name: make(100) for name, (_, make) in classify.models(trees=7, iterations=9).items()}
    assert made["random_forest"].getNumTrees() == 7 and made["logistic_regression"].getMaxIter() == 9
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", float(i % 7), str(i % 2)) for i in range(60)], "id long, kind string, n double, label0 string")
    for model in ("random_forest", "logistic_regression"):
        got = classify.out_of_fold(df, "id", ["kind", "n"], "label0", model, 2, trees=3, iterations=5)
        assert got.count() == 60


def test_all_patterns_of_many_attributes_match(spark):
    attrs = [f"q{i}" for i in range(13)]
    release = spark.range(1 << 13).select(*[F.when(F.col("id").bitwiseAND(F.lit(1 << i)) > 0, "*").otherwise(f"v{i}").alias(a) for i, a in enumerate(attrs)])
    projected = spark.createDataFrame([(1, *[f"v{i}" for i in range(13)]), (2, "other", *[f"v{i}" for i in range(1, 13)]), (3, *["x"] * 13)], ", ".join(["id long", *[f"p_{a} string" for a in attrs]]))
    assert {r["id"]: r["stage1_size"] for r in attacks.stage1(projected, release, "id", attrs).collect()} == {1: 1 << 13, 2: 1 << 12, 3: 1}


def test_patterns_joined_at_once_or_one_by_one(spark, monkeypatch):
    rng = random.Random(6)
    release = spark.createDataFrame([tuple(rng.choice(["a", "b", "*", None]) for _ in range(3)) for _ in range(80)], "x string, y string, z string")
    projected = spark.createDataFrame([(i, *[rng.choice(["a", "b", "c", None]) for _ in range(3)]) for i in range(40)], "id long, p_x string, p_y string, p_z string")
    rel = attacks._release_tuples(release, ["x", "y", "z"])
    get = lambda: sorted(str(sorted(r.asDict().items())) for r in attacks._tuple_matches(projected, rel, ["x", "y", "z"]).collect())
    one_by_one = get()
    monkeypatch.setattr(attacks, "PATTERNS", 2)
    assert get() == one_by_one and one_by_one


def test_values_at_the_threshold_are_common(spark):
    column = lambda *values: spark.createDataFrame([(v,) for v in values], "c string")
    for x, y in (("abcde", "abcdx"), ("abcdefghij", "abcdefghxy")):
        assert schema_match.fuzzy_jaccard_scores(column(x), column(y), ["c"], ["c"]).first()["score"] == 1
    assert schema_match.fuzzy_jaccard_scores(column("abcd"), column("abcx"), ["c"], ["c"]).first()["score"] == 0


def test_best_node_is_best_with_closeness(spark):
    # the rare old are all ill, so their classes are too far from all rows: their loss is not the average one
    rows = [(i, "young", "ab"[i % 2], "ab"[i // 2 % 2]) for i in range(80)] + [(80 + i, "old", "ab"[i % 2], "b") for i in range(12)]
    people = spark.createDataFrame(rows, "id long, age string, sex string, illness string")
    hierarchies = [Hierarchy("age", exprs=(lambda c: c, lambda c: F.lit("*"))), by_expression("sex")]
    model = A.Model(2, 1, 0.3, 0.2)
    freq = A.frequencies(people, hierarchies, "illness")
    nodes = A.lattice(hierarchies)
    found = {r["node"]: r["n_suppressed"] for r in A.scan(freq, nodes, model).collect()}
    at = nodes.index((0, 1))
    assert found[at] == 12
    # all sexes are one class of two values, so kept rows lose 1 there; the old are lost whole
    lost = A.losses(freq, nodes, model)
    assert lost[at][0] == pytest.approx(12 / 92) and lost[at][1] == pytest.approx(1)
    best = A.best_node(freq, model, aggregate_by="arithmetic_mean")
    assert best["score"] == pytest.approx(min(A.aggregate("arithmetic_mean", lost[i]) for i in lost if found[i] <= 0.2 * 92))


def classes_of_records(rng, n=16, kinds=5):
    """(pairs of classes, members, weights of all pairs of their records)."""
    sides = []
    for _ in range(2):
        kind = [rng.randrange(kinds) for _ in range(n)]
        own = [[i for i in range(n) if kind[i] == k] for k in range(kinds)]
        sides.append({v[0]: v for v in own if v})
    edges = [(a, b, rng.randint(1, 5) / 5, len(sides[0][a]), len(sides[1][b])) for a, b in itertools.product(*sides) if rng.random() < 0.7]
    members = [(s, i, c, len(v)) for s in (0, 1) for c, v in sides[s].items() for i in v]
    return edges, members, [(i, j, w) for a, b, w, _, _ in edges for i in sides[0][a] for j in sides[1][b]]


@pytest.fixture(scope="module", params=[1, 2])
def copies(spark, request):
    edges, members, records = classes_of_records(random.Random(request.param))
    return spark.createDataFrame(edges, "id1 long, id2 long, weight double, m1 long, m2 long"), spark.createDataFrame(members, "side int, id long, class long, n long"), records


def pairs_of(df):
    return sorted((r["id1"], r["id2"], r["weight"]) for r in df.collect())


def test_classes_with_members_say_all_pairs(copies):
    found = encode.with_members(copies[0], copies[1]).collect()
    of = {k: [(r["id1"], r["id2"]) for r in found if r["kind"] == k] for k in ("pair", "first", "second")}
    assert sorted(of["pair"]) == sorted((r["id1"], r["id2"]) for r in copies[0].collect()) and len(found) == copies[0].count() + copies[1].count()
    records = [(i, j) for a, b in of["pair"] for i, c in of["first"] if c == a for j, d in of["second"] if d == b]
    assert sorted(records) == sorted((a, b) for a, b, _ in copies[2])


def test_keys_of_blocks_are_compiled(spark, tmp_path, capsys):
    spark.createDataFrame([(s, i, [i % 4, 4 + i % 3]) for s in (0, 1) for i in range(6)], "side int, id long, bits_a array<int>").write.parquet(f"{tmp_path}/enc")
    enc = spark.read.parquet(f"{tmp_path}/enc")
    block.bit_blocks(enc, 1024, 24, 8).explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8_000  # the JVM only interprets longer methods
    keys = {(r["side"], r["id"], r["key"]) for r in block.bit_blocks(enc, 8, 3, 2).collect()}
    of = lambda i, p: "".join("01"[x in (i % 4, 4 + i % 3)] for x in p)
    assert keys == {(s, i, f"{t}:{of(i, p)}") for s in (0, 1) for i in range(6) for t, p in enumerate(block.draw(range(8), 3, 2, 42))}


def test_lsh_counts_the_records_of_classes(spark):
    # bit 1 is in one of two classes, but in 9 of 10 records
    classes = spark.createDataFrame([(0, 0, 9, [0, 1]), (1, 1, 1, [0, 2])], "side int, id long, n long, bits_a array<int>")
    records = spark.createDataFrame([(0, i, [0, 1]) for i in range(9)] + [(1, 9, [0, 2])], "side int, id long, bits_a array<int>")
    assert block.lsh_positions(classes, 4, 0.9) == block.lsh_positions(records, 4, 0.9) == [1, 2]
    assert block.lsh_positions(classes, 4, 0.8) == block.lsh_positions(records, 4, 0.8) == []
    with pytest.raises(ValueError):
        block.lsh_positions(classes, 4, 0.8, sample=5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_lsh_pairs_lose_no_pair_of_records(spark):
    from cloakwork.plans import catalogue, microdata

    found = catalogue.queries()["lsh_pairs"](spark, "/root/testdata/sf0.001").toPandas()
    of = {k: g for k, g in found.groupby("kind")[["id1", "id2"]]}
    records = of["pair"].merge(of["first"], left_on="id1", right_on="id2").merge(of["second"], left_on="id2_x", right_on="id2")
    enc = microdata.encodings(spark, "/root/testdata/sf0.001")
    want = block.candidate_pairs(block.lsh_blocks(enc, 1024, 24, 8, 0.8)).toPandas()
    assert len(want) and len(of["first"]) == len(of["second"]) == enc.count() // 2
    assert sorted(zip(records.iloc[:, 2], records["id1"])) == sorted(zip(want["id1"], want["id2"]))


def test_classes_expand_to_all_pairs(copies):
    assert pairs_of(encode.expanded(copies[0].select("id1", "id2", "weight"), copies[1], most=2)) == sorted(copies[2])


def test_unique_mapping_of_classes_is_greedy(copies):
    assert {(r["id1"], r["id2"]) for r in cluster.unique_mapping_classes(*copies[:2]).collect()} == greedy([e for e in copies[2] if e[2] > 0.1])


def test_rest_of_unique_mapping_in_one_pass(spark, copies, monkeypatch):
    pairs = lambda **k: {(r["id1"], r["id2"]) for r in cluster.unique_mapping_classes(*copies[:2], **k).collect()}
    want = greedy([e for e in copies[2] if e[2] > 0.1])
    # rounds to the end; a round first, as records or pairs are too many for one pass; all in one pass
    assert pairs(one_pass=(0, 0)) == pairs(one_pass=(20, 26)) == pairs(one_pass=(12, 99)) == want
    # many copies with ties across classes: one pass and no round
    n, rows = 40, []
    monkeypatch.setattr(cluster, "written", lambda df, name: rows.append(name) or real(df, name))
    real = scratch.written
    edges = [(a, b, 0.5, n, n) for a, b in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 0))] + [(3, 0, 0.4, n, n), (2, 3, 0.3, n, n), (4, 3, 0.3, n, n)]
    members = [(s, c + 5 * i, c, n) for s in (0, 1) for c in range(5 - s) for i in range(n)]
    all_pairs = [(a + 5 * i, b + 5 * j, w) for a, b, w, _, _ in edges for i in range(n) for j in range(n)]
    found = cluster.unique_mapping_classes(spark.createDataFrame(edges, "id1 long, id2 long, weight double, m1 long, m2 long"), spark.createDataFrame(members, "side int, id long, class long, n long"))
    assert {(r["id1"], r["id2"]) for r in found.collect()} == greedy(all_pairs) and len(rows) <= 3


def test_centers_of_classes_equal_one_pass(copies):
    kept = {(r["id1"], r["id2"]) for r in cluster.center_edges_classes(*copies[:2], 0.3).collect()}
    assert kept == centers_one_by_one(copies[2], 0.3)


def test_pruning_of_classes_equals_that_of_records(spark, copies):
    records = spark.createDataFrame(copies[2], "id1 long, id2 long, weight double")
    for most in (1, 7, 40, 10_000):
        assert pairs_of(metablock.cep_classes(copies[0], most, copies[1])) == pairs_of(metablock.cep(records, most))
    for k, both in itertools.product((1, 4), (False, True)):
        assert pairs_of(metablock.cnp_classes(copies[0], k, copies[1], both)) == pairs_of(metablock.cnp(records, k, both))
    assert pairs_of(encode.expanded(metablock.blast(copies[0]), copies[1])) == pairs_of(metablock.blast(records))


def test_recall_of_classes_equals_that_of_records(spark, copies):
    records = spark.createDataFrame(copies[2], "id1 long, id2 long, weight double")
    truth = spark.createDataFrame([(i, (i * 7) % 16) for i in range(16)] + [(1, 1), (2, 2)], "id1 long, id2 long")
    curve = lambda df: sorted((r["pos"], r["hit"], r["recall"]) for r in df.collect())
    assert curve(evaluate.recall_curve_classes(copies[0], copies[1], truth, 3)) == curve(evaluate.recall_curve(records, truth))
    assert list(evaluate.normalized_auc(copies[0], truth, copies[1]).first()) == pytest.approx(list(evaluate.normalized_auc(records, truth).first()))
    assert evaluate.pair_scores(copies[0], truth, 16, 16, copies[1]).first() == evaluate.pair_scores(records, truth, 16, 16).first()
    assert pairs_of(cluster.isolated_edges(copies[0]).select("id1", "id2", "weight")) == pairs_of(cluster.isolated_edges(records))


def test_recalls_are_rounded_once_a_run(spark, copies):
    truth = spark.createDataFrame([(i, (i * 7) % 16) for i in range(16)], "id1 long, id2 long")
    rows = lambda df: sorted((r["pos"], r["hit"], r["recall"]) for r in df.collect())
    found = evaluate.recall_curve_classes(copies[0], copies[1], truth, 3, digits=3)
    assert rows(found) == rows(evaluate.recall_curve(spark.createDataFrame(copies[2], "id1 long, id2 long, weight double"), truth).withColumn("recall", F.round("recall", 3)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # nothing but the hit is worked out for each position
    assert "round(" not in plan[: plan.index("Generate explode")] and "round(" in plan


def test_weights_without_a_true_pair_are_one_row(spark, monkeypatch):
    n, rows = 30, []
    real = evaluate.running
    monkeypatch.setattr(evaluate, "running", lambda df, *a: rows.append(df.count()) or real(df, *a))
    edges = [(0, 0, 0.9, n, n), (0, 1, 0.8, n, n), (1, 0, 0.7, n, n), (1, 1, 0.8, n, n)]
    members = [(s, 2 * i + c, c, n) for s in (0, 1) for c in (0, 1) for i in range(n)]
    edges, members = spark.createDataFrame(edges, "id1 long, id2 long, weight double, m1 long, m2 long"), spark.createDataFrame(members, "side int, id long, class long, n long")
    truth = spark.createDataFrame([(2, 2), (4, 6)], "id1 long, id2 long")
    records = encode.expanded(edges.select("id1", "id2", "weight"), members)
    want = [r["pos"] for r in evaluate.recall_curve(records, truth).orderBy("pos").collect() if r["hit"]]
    assert sorted(r["pos"] for r in evaluate.hit_positions(edges, members, truth).collect()) == want
    # 30 records at 0.9, one row each for 0.8 and 0.7
    assert rows == [n + 2]


def test_classes_of_equal_bits(spark):
    rows = spark.createDataFrame([(0, 1, "ab"), (0, 2, "AB"), (0, 3, None), (1, 4, "ab"), (1, 5, "b")], "side int, id long, text string")
    found, members = encode.classes(rows, "text", BloomConfig(64, 2, q=2))
    assert sorted((r["side"], r["id"], r["n"]) for r in found.collect()) == [(0, 1, 2), (0, 3, 1), (1, 4, 1), (1, 5, 1)]
    assert sorted((r["side"], r["id"], r["class"]) for r in members.collect()) == [(0, 1, 1), (0, 2, 1), (0, 3, 3), (1, 4, 4), (1, 5, 5)]


def test_neighbours_of_classes(spark):
    rng = random.Random(3)
    words = [rng.choice([3, 5, 9, 14]) for _ in range(24)]
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    records = spark.createDataFrame([(i, [w]) for i, w in enumerate(words)], "id long, words array<long>")
    members = spark.createDataFrame([(i, first[w]) for i, w in enumerate(words)], "id long, class long")
    own = spark.createDataFrame([(i, [w]) for w, i in first.items()], "id long, words array<long>")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "shared", "similarity", "rank").collect()))
    assert rows(block.jaccard_knn(own, own, "words", 4, members=(members, members))) == rows(block.jaccard_knn(records, records, "words", 4))


def test_multihash_neighbours_equal_brute_force(spark):
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(70), rng.randint(0, 12))) for _ in range(40)]
    sets += sets[:8]
    drawn = block.draw(range(70), 3, 4, 42)
    alike = lambda a, b: any(all((p in a) == (p in b) for p in ps) for ps in drawn)
    want = []
    for q, a in enumerate(sets[:20]):
        near = [(i, len({*a} & {*b}), len({*a} | {*b})) for i, b in enumerate(sets) if i != q and alike(a, b)]
        best = sorted((-(s / u if u else 0.0), i, s) for i, s, u in near)[:5]
        want += [(q, i, s, -j, k + 1) for k, (j, i, s) in enumerate(best)]
    rows = lambda ids: spark.createDataFrame([(i, sets[i]) for i in ids], "id long, bits array<int>")
    got = lambda df: sorted(map(tuple, df.select("query_id", "id", "shared", "similarity", "rank").collect()))
    assert got(block.multihash_knn(rows(range(20)), rows(range(48)), "bits", 70, 5, tables=4, width=3, broadcast_rows=7)) == sorted(want)
    first = {tuple(b): i for i, b in reversed(list(enumerate(sets)))}
    members = lambda n: spark.createDataFrame([(i, first[tuple(b)]) for i, b in enumerate(sets[:n])], "id long, class long")
    own = rows(sorted(first.values()))
    asked = rows(sorted({first[tuple(b)] for b in sets[:20]}))
    found = block.multihash_knn(asked, own, "bits", 70, 5, tables=4, width=3, members=(members(20), members(48)))
    assert got(found) == sorted(want)
    # pairs are scored where they meet, so no lists of bits are dealt out with them
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "array_union" not in plan


def test_common_words_summed_at_once(spark):
    from cloakwork.functions.bloom import packed, shared_bits

    df = spark.createDataFrame([([0, 63, 64, 99], [0, 64, 98]), ([], [5]), ([63], [63])], "a array<int>, b array<int>")
    a, b = packed(F.col("a"), 100), packed(F.col("b"), 100)
    assert [tuple(r) for r in df.select(shared_bits(a, b), shared_bits(a, b, 100)).collect()] == [(2, 2), (0, 0), (1, 1)]


def test_bits_packed_by_token_equal_the_expression(spark):
    from cloakwork.functions.bloom import BloomConfig, encode as positions, packed, with_words

    df = spark.createDataFrame([(x,) for x in ["", None, "a", "Grün ß-Straße 12", "_ _", "日本語 x", "aa aa AA", "ab" * 40]], "t string")
    for c in (BloomConfig(1024, 15, q=4), BloomConfig(100, 3, q=5, salt="s"), BloomConfig(64, 7, kind="tokens")):
        for r in with_words(df, "t", c).select("words", packed(positions(F.col("t"), c), c.size).alias("w")).collect():
            assert r["words"] == r["w"]


def test_nearest_passes_over_unlike_groups(monkeypatch):
    import numpy as np

    from cloakwork.operators.pprl import nearest as N

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (64, 4), dtype=np.uint64) & rng.integers(0, 2**63, (64, 4), dtype=np.uint64)
    w = np.repeat(base, 32, axis=0) ^ (np.uint64(1) << rng.integers(0, 63, (2048, 4), dtype=np.uint64))
    ids, q = np.arange(2048), w[::100].copy()
    seen, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: seen.append(len(x)) or count(x))
    got = N.nearest(ids[::100], q, ids, w, 256, 5)
    assert sum(seen) < 2048 * len(q) / 2
    for i, x in enumerate(q):
        both = count(w & x).sum(axis=1, dtype=int)
        s = both / (count(w).sum(axis=1, dtype=int) + int(count(x).sum()) - both)
        best = np.lexsort((ids, -s))[:5]
        at = got[0] == 100 * i
        assert got[1][at].tolist() == best.tolist() and got[3][at].tolist() == s[best].tolist()


def test_jaccard_neighbours_across_blocks(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(i, [rng.getrandbits(20) & rng.getrandbits(20), rng.getrandbits(9)]) for i in range(60)], "id long, words array<long>")
    got = lambda df: sorted(map(tuple, df.select("query_id", "id", "shared", "similarity", "rank").collect()))
    assert got(block.jaccard_knn(rows.filter("id < 9"), rows, "words", 4, block_rows=20)) == got(block.jaccard_knn(rows.filter("id < 9"), rows, "words", 4))


def test_agreeing_pairs_meet_once_without_a_shuffle_of_pairs(spark):
    from cloakwork.functions.bloom import packed

    rng = random.Random(5)
    sets = [sorted(rng.sample(range(100), rng.randint(0, 30))) for _ in range(40)]
    df = spark.createDataFrame([(i % 2, i, b) for i, b in enumerate(sets)], "side int, id long, bits_a array<int>")
    drawn = block.draw(range(100), 3, 4, 42)
    coded = df.select("side", "id", block.sampled_codes(packed(F.col("bits_a"), 100), drawn).alias("codes"))
    found = block.agreeing_pairs(coded, 4)
    got = [tuple(r) for r in found.collect()]
    want = {tuple(r) for r in block.candidate_pairs(block._keyed(df, F.col("bits_a"), drawn)).collect()}
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    with_n = df.withColumn("n", F.col("id") + 1)
    assert block.lsh_positions(with_n.select("side", "id", "n", packed(F.col("bits_a"), 100).alias("words")), 100, 0.8) == block.lsh_positions(with_n, 100, 0.8)
