"""The microdata and record pairs that the catalogue's queries work on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bloom import BloomConfig
from ..operators.hierarchy import Hierarchy, band, by_expression, by_table
from ..operators.pprl.encode import classes, encode_party, union
from ..sources.scratch import spread

K, L = 5, 2
BLOOM = BloomConfig(size=1024, hashes=15, kind="qgrams", q=4)
#: Bits of a block key.
ADJACENT = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, place (nation), balance, segment, region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("place"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))


def place_hierarchy(spark: SparkSession, sf_dir: str) -> Hierarchy:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return by_table("place", n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("leaf"), F.array("n_name", "r_name", F.lit("*")).alias("levels")))


def balance_hierarchy() -> Hierarchy:
    return Hierarchy("balance", exprs=(band(100), band(1000), band(5000), lambda c: F.lit("*")))


def customer_hierarchies(spark: SparkSession, sf_dir: str) -> list[Hierarchy]:
    return [place_hierarchy(spark, sf_dir), balance_hierarchy()]


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, day, priority, price, status."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def order_hierarchies() -> list[Hierarchy]:
    return [
        by_expression("day", lambda c: F.substring(c, 1, 7), lambda c: F.substring(c, 1, 4)),
        by_expression("priority", lambda c: F.when(F.substring(c, 1, 1).isin("1", "2"), "high").otherwise("other")),
        Hierarchy("price", exprs=(band(1000), band(20000), band(100000), lambda c: F.lit("*"))),
    ]


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quantity, month, flag, status; rows have no key."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_quantity").alias("quantity"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def line_hierarchies() -> list[Hierarchy]:
    return [Hierarchy("quantity", exprs=(band(5), band(10), band(25), lambda c: F.lit("*"))), by_expression("month", lambda c: F.substring(c, 1, 4)), by_expression("flag")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, quality, toxic, and a fixed score between 0 and 1."""
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.withColumn("score", F.col("n_chars") / (F.col("n_chars") + 1500.0))


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b): each part's text, and the second party's spelling of it (one of four kinds, by key)."""
    p = table(spark, sf_dir, "part")
    a = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    kind = F.col("p_partkey") % 4
    b = F.when(kind == 0, a).when(kind == 1, F.concat(F.substring(a, 1, 1), F.substring(a, 3, 1000))).when(kind == 2, F.concat(a, F.lit("x"))).otherwise(F.upper(a))
    return p.select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"))


def encodings(spark: SparkSession, sf_dir: str, config: BloomConfig = BLOOM) -> DataFrame:
    """(side, id, bits_text) of both parties."""
    p = spread(parties(spark, sf_dir))
    return union([encode_party(p.select("id", F.col("a").alias("text")), 0, "id", ["text"], config), encode_party(p.select("id", F.col("b").alias("text")), 1, "id", ["text"], config)])


def encoding_classes(spark: SparkSession, sf_dir: str, config: BloomConfig = BLOOM, dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes (side, id, n, bits_text; dense: words) of both parties' records with the same bits, and their members."""
    p = parties(spark, sf_dir)
    return classes(union([p.select(F.lit(s).alias("side"), F.col("id").cast("long").alias("id"), F.col(x).alias("text")) for s, x in enumerate("ab")]), "text", config, dense)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id1"), F.col("p_partkey").alias("id2"))


def sign_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, words): the signs of an embedding's components as bits of one long."""
    e = table(spark, sf_dir, "embeddings")
    word = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return e.select(F.col("vec_id").alias("id"), F.array(word).alias("words"))


def band_sql(x: str, w: int) -> str:
    lo = f"CAST(floor(greatest(CAST({x} AS DOUBLE), 0) / {w}) * {w} AS BIGINT)"
    return f"({lo} || '-' || ({lo} + {w}))"


CUSTOMERS_SQL = """c AS (SELECT c_custkey AS id, n_name AS place, c_acctbal AS balance, c_mktsegment AS segment, r_name AS region
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ORDERS_SQL = """o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS priority, o_totalprice AS price, o_orderstatus AS status FROM orders)"""
LINES_SQL = """x AS (SELECT l_quantity AS quantity, strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"""
DOCS_SQL = """d AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, n_chars / (n_chars + 1500.0::DOUBLE) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
PLACE_LEVELS = ("place", "region", "'*'")
BALANCE_LEVELS = (band_sql("balance", 100), band_sql("balance", 1000), band_sql("balance", 5000), "'*'")
PARTIES_SQL = """p0 AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size AS a FROM part),
    p AS (SELECT id, a, CASE id % 4 WHEN 0 THEN a WHEN 1 THEN substr(a, 1, 1) || substr(a, 3) WHEN 2 THEN a || 'x' ELSE upper(a) END AS b FROM p0)"""
