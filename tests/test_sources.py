from pyspark.sql import functions as F

from cloakwork.sources import files


def test_csv_readings(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(" a ,b\n1, x \n,*\n")
    text = files.read_csv_text(spark, str(p))
    assert text.columns == ["a", "b"] and [tuple(r) for r in text.collect()] == [("1", "x"), ("", "*")]
    assert [r[0] for r in files.read_csv_missing(spark, str(p)).collect()] == ["1", "nan"]
    assert files.header_of(spark, str(p)) == ["a", "b"]


def test_ragged_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("a,b\n1\n1,2,3\n")
    assert [tuple(r) for r in files.read_csv_ragged(spark, str(p)).collect()] == [("1", None), ("1", "2")]


def test_hierarchy_and_export(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("17, 15-19,*\n?,Unknown\n\n")
    rows = {r["leaf"]: r["levels"] for r in files.read_hierarchy(spark, str(p), "age").collect()}
    assert rows == {"17": ["17", "15-19", "*"], "?": ["?", "Unknown"]}
    df = spark.createDataFrame([("*", "*"), ("a", "*")], "p string, q string")
    kept, counts = files.drop_fully_suppressed(df, ["p", "q"])
    assert kept.count() == 1 and tuple(counts.first()) == (2, 1, 1)
    assert files.suppressed_columns(df, ["p", "q"]) == ["q"]


def test_sinks(spark, tmp_path):
    df = spark.range(2).select(F.col("id"), F.array(F.lit(1), F.lit(2)).alias("xs"))
    files.write_csv(df, str(tmp_path / "o"))
    assert files.read_csv_text(spark, str(tmp_path / "o")).first()["xs"] == "1|2"
    files.append_rows(spark.range(1), str(tmp_path / "s"))
    files.append_rows(spark.range(1).withColumn("extra", F.lit("x")), str(tmp_path / "s"))
    assert sorted(files.read_summary(spark, str(tmp_path / "s")).columns) == ["extra", "id"]
    files.save_json({"a": float("nan"), "b": {2, 1}}, str(tmp_path / "j.json"))
    assert files.load_json(str(tmp_path / "j.json")) == {"a": None, "b": [1, 2]}
    assert files.ratio(10) == 0.1 and files.ratio(0.1) == 0.1
