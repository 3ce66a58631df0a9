import os

import pytest
from brute import near_duplicates

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from cloakwork.llm import mixing  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(corpus_pipeline.PIECES), reason="needs the driver's tables and tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, __lang int"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    after = corpus_pipeline.language(spark, docs, DATA)
    assert after.columns == docs.columns
    letters = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    assert after.count() == len(letters)
    exact = corpus_pipeline.exact(spark, after, DATA)
    keep = {}
    for i, t in letters:
        keep[t] = max(i, keep.get(t, i))
    assert sorted(r[0] for r in exact.select("doc_id").collect()) == sorted(keep.values())
    near = corpus_pipeline.near(spark, exact, DATA)
    comp = near_duplicates([(i, t) for t, i in keep.items()], 5)
    assert sorted(r[0] for r in near.select("doc_id").collect()) == sorted(i for i, (_, c) in comp.items() if i == c)
    mixed = corpus_pipeline.mix(spark, near, DATA)
    taken = {r["doc_id"]: round(r["taken"] / r["size"] + 1e-9) for r in mixing.mix(near).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    out = corpus_pipeline.tokens(spark, mixed, DATA)
    assert out.count() == mixed.count() and out.filter("not round_trip").count() == 0


def test_odd_rows_through_all_stages(spark):
    rows = [(1, None, "en", "a", 0, "s", 1), (2, "", None, None, 0, "s", 1), (3, "the of and", "en", "a", 1, "s", 1), (4, "the of and", "en", "a", 1, "s", 1), (4, "the of and", "en", "a", 1, "s", 1), (None, "the and of", None, "b", 1, "s", 1), (5, "123", "en", None, 0, "s", 1), (6, "the " * 5000, "en", "b", 1, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    ids = {r["doc_id"] for r in docs.collect()}
    assert ids <= {4, None, 6} and ids
    near = corpus_pipeline.near(spark, spark.createDataFrame([(1, "a b", "KEPT", 1, 2), (2, "a b", "x", 3, 4), (2, "c d", "y", 5, 6)], "doc_id long, text string, lang string, __KEEP int, __sha256 int"), DATA)
    assert sorted(tuple(r) for r in near.collect()) == [(1, "a b", "KEPT", 1, 2), (2, "c d", "y", 5, 6)]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
