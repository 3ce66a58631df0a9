import os

import pytest

DATA = "/root/testdata/sf0.001"
NAMES = [
    "k_anonymity_classes", "t_closeness_classes", "generalize_release", "lattice_scan", "optimal_node_loss", "class_statistics", "attribute_quality", "divergence_numeric", "wasserstein", "correlation_delta",
    "linkage_summary", "linkage_stage2", "membership_metrics", "naive_bayes_counts", "roc_points", "bloom_skipgrams", "weight_x2", "prune_wnp", "cosine_pairs", "connected_components", "cluster_evaluation", "hamming_knn", "stream_window_group_sizes",
    "utility_summary", "schema_mapping_evaluation", "instance_schema_match", "fuzzy_schema_match", "unique_mapping", "center_clusters",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def values(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(map(str, pdf.astype(object).where(pdf.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    from cloakwork.plans import catalogue

    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = tables.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
