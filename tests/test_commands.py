import json

import pytest
from pyspark.sql import functions as F

from cloakwork import cli
from cloakwork.operators import attacks, ranges, reporting, sampling
from cloakwork.operators.pprl import block, cluster
from cloakwork.plans import benchmarks


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("commands")
    rows = [(i, ["lille", "lens", "nice"][i % 3], ["f", "m"][i % 2], ["flu", "cold", "flu", "none"][i % 4]) for i in range(120)]
    spark.createDataFrame(rows, "id long, town string, sex string, illness string").coalesce(1).write.csv(f"{where}/people", header=True)
    (where / "levels").mkdir()
    (where / "levels" / "town.csv").write_text("lille,north,*\nlens,north,*\nnice,south,*\n")
    return f"file://{where}", where


def test_a_release_and_two_attacks(spark, files):
    uri, where = files
    cli.main(["split", "--input", f"{uri}/people", "--output", f"{uri}/split", "--id", "id", "--share", "0.2", "--metadata", f"{where}/split.json"], spark)
    record = json.loads((where / "split.json").read_text())
    assert (record["n_published"], record["n_out"]) == (108, 12)
    published = f"{uri}/split/published.parquet"
    cli.main(["anonymize", "--input", published, "--output", f"{uri}/release.parquet", "--qis", "town", "--sensitive", "illness", "--hierarchies", f"{uri}/levels", "--k", "3", "--metrics", f"{where}/m.json"], spark)
    assert json.loads((where / "m.json").read_text())["n_suppressed"] == 0
    cli.main(["targets", "--published", published, "--out", f"{uri}/split/out.parquet", "--release", f"{uri}/release.parquet", "--output", f"{uri}/targets.parquet", "--id", "id", "--known", "town,sex", "--metadata", f"{where}/t.json"], spark)
    assert json.loads((where / "t.json").read_text()) == {"n_published": 108, "n_survivors": 108, "drop_rate": 0.0, "n_in": 12, "n_out": 12}
    cli.main(["member", "--targets", f"{uri}/targets.parquet", "--release", f"{uri}/release.parquet", "--output", f"{uri}/member.parquet", "--id", "id", "--page", f"{where}/member.html"], spark)
    assert spark.read.parquet(f"{uri}/member.parquet").count() == 24 and "Best threshold" in (where / "member.html").read_text()
    cli.main(["auxiliary", "--input", f"{uri}/people", "--release", f"{uri}/release.parquet", "--output", f"{uri}/base.parquet", "--id", "id", "--known", "town,sex", "--size", "9"], spark)
    cli.main(["link", "--targets", f"{uri}/base.parquet", "--release", f"{uri}/release.parquet", "--truth", published, "--output", f"{uri}/link.parquet", "--id", "id", "--sensitive", "illness", "--page", f"{where}/link.html"], spark)
    found = spark.read.parquet(f"{uri}/link.parquet")
    assert found.count() == 9 and "Guesses by true value" in (where / "link.html").read_text()
    counts = attacks.operation_counts(found, 108, 0, 2).first()
    assert counts["refinement_tests"] == 9 * 108 * 2 and counts["filter_tests"] == 0


def test_runs_keep_what_is_there(spark, files):
    uri, _ = files
    releases = {"a": f"{uri}/people", "b": f"{uri}/nowhere.csv"}
    original = benchmarks.read_any(spark, f"{uri}/people")
    runs = benchmarks.utility_benchmark(spark, original, releases, ["town"], ["illness"], f"{uri}/utility")
    assert {r["release"]: r["status"] for r in runs.collect()} == {"a": "success", "b": "missing"}
    again = benchmarks.utility_benchmark(spark, original, releases, ["town"], ["illness"], f"{uri}/utility")
    assert {r["release"]: r["status"] for r in again.collect()} == {"a": "skipped", "b": "missing"}
    assert benchmarks.results(again).first()["mean_tvd_all"] == 0
    metrics = spark.createDataFrame([("m", 0.5), ("m", 1.0), ("m", None)], "model string, auc double")
    assert benchmarks.average_auc(metrics, ["model"]).first()["average_auc"] == 0.75


def test_orders_in_ranges(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("x")).repartition(5)
    assert [r["k"] for r in ranges.ranked(df, [F.col("x")], "k").orderBy("x").collect()] == list(range(500))
    some = df.withColumn("v", F.when(F.col("x") % 50 == 3, F.col("x")))
    assert [r["v"] for r in ranges.carried(some, [F.col("x")], ["v"]).orderBy("x").collect()] == [None] * 3 + [(x - 3) // 50 * 50 + 3 for x in range(3, 500)]


def test_samples_by_cells_are_those_by_order(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "key")
    small = {r[0] for r in sampling.sample(df, "key", 700).collect()}
    monkeypatch.setattr(sampling, "TOP", 10)
    assert {r[0] for r in sampling.sample(df, "key", 700).collect()} == small and sampling.sample(df, "key", 5000).count() == 3000
    assert (sampling.held_out_size(100, share=0.2), sampling.held_out_size(100, size=30), sampling.held_out_size(100)) == (10, 15, 5)
    for bad in ({"size": 1}, {"share": 1.0}, {"size": 4, "share": 0.5}):
        with pytest.raises(ValueError):
            sampling.held_out_size(100, **bad)


def test_what_an_attacker_knows(spark):
    release = spark.createDataFrame([("*", "x", 1), ("**", "*", 2)], "a string, b string, is_member int")
    assert attacks.with_suppressed_columns({"a": 0, "b": 0, "c": 2}, release, ["a", "b", "c"]) == {"a": 1, "b": 0, "c": 2}
    assert attacks.known_attributes(release.withColumn("id", F.lit(1)), "id") == ["a", "b"] and attacks.known_attributes(release, "id", ["b"]) == ["b"]
    assert attacks.mapped_known(["a", "b"], {"col_0": "b"}) == (["b"], ["a"])
    kinds = spark.createDataFrame([("x", "g", "x"), ("x", "g", "*"), ("x", "g", "g"), ("x", "g", "y")], "t string, p string, r string")
    got = kinds.select(attacks.compatibility(F.col("t"), F.col("p"), F.col("r"), F.lit(0.9)).alias("k")).select("k.*").collect()
    assert [tuple(r) for r in got] == [("exact", 1.0), ("suppressed", 0.25), ("generalized", 0.5), ("fuzzy", 0.9)]


def test_neighbours_and_matching_clusters(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 4]), (3, [7]), (4, [1, 2, 3])], "id long, bits array<int>")
    found = block.multihash_knn(rows, rows, "bits", 8, 2, tables=4, width=1).collect()
    assert all(0 <= r["similarity"] <= 1 and r["rank"] <= 2 for r in found) and ("1", 4) in {(str(r["query_id"]), r["id"]) for r in found}
    pairs = spark.createDataFrame([(1, 5, 0.9)], "id1 long, id2 long, weight double")
    records = spark.createDataFrame([(0, 1), (0, 2), (1, 5), (1, 6)], "side int, id long")
    assert {(r["side"], r["id"]): r["cluster_id"] for r in cluster.matching_clusters(pairs, records).collect()} == {(0, 1): 2, (1, 5): 2, (0, 2): 4, (1, 6): 13}


def test_values_on_pages(spark):
    assert [reporting.shown(x) for x in (None, 1234567, 0.5, True, "<")] == ["", "1 234 567", "0,5", "True", "&lt;"] and reporting.percent(0.125) == "12,5 %"
    df = spark.createDataFrame([(" Yes",), ("0",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(reporting.to_bool(F.col("v"))).collect()] == [True, False, None, None]
    assert "The first 2 rows." in reporting.section("t", df, 2) and "first" not in reporting.section("t", df, 4)
