import hashlib

from pyspark.sql import functions as F

from cloakwork.functions import text as X
from cloakwork.functions.bloom import BloomConfig, chunk_keys, different_bits, encode, packed, shared_bits, similarity


def one(spark, expr, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("r")).first()["r"]


def test_midpoints(spark):
    cases = {"35-39": 37.0, "30–39": 34.5, "25": 25.0, "*": None, "?": None, "": None, "00-19": 9.5, "nan": None, "-5": -5.0, "a": None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", X.range_midpoint(F.col("v")).alias("m")).collect()
    assert {r["v"]: r["m"] for r in rows} == cases


def test_suppressed(spark):
    rows = spark.createDataFrame([("*",), ("***",), ("",), (" ",), ("a",), ("*a",), (None,)], "v string").select(X.is_suppressed(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in rows] == [True, True, True, True, False, False, True]


def oracle(word, m, h, q):
    out = set()
    for t in {t for t in __import__("re").split(r"[\W_]+", word.lower()) if t}:
        t = f"_{t}_".ljust(q, "_")
        for i in range(len(t) - q + 1):
            d = hashlib.sha256(t[i : i + q].encode()).digest()
            a, b = int.from_bytes(d[:16], "little"), int.from_bytes(d[16:], "little")
            out.update((a + j * b) % m for j in range(h))
    return sorted(out)


def test_bloom_qgrams_known_bits(spark):
    c = BloomConfig(1024, 15, kind="qgrams", q=4)
    known = [21, 104, 154, 176, 177, 200, 259, 331, 342, 345, 368, 391, 414, 497, 559, 569, 582, 605, 652, 724, 735, 750, 773, 796, 807, 890, 962, 964, 987, 1010]
    assert one(spark, encode(F.col("v"), c), "Bob") == known
    for m, word in ((1000, "Ann-Marie o_Neil"), (997, "Zoë x"), (1024, "")):
        assert one(spark, encode(F.col("v"), BloomConfig(m, 15, kind="qgrams", q=4)), word) == oracle(word, m, 15, 4)


def test_bloom_string_known_bits(spark):
    assert one(spark, encode(F.col("v"), BloomConfig(1024, 3, kind="string")), "Bob") == [141, 212, 255, 421, 432, 666, 779, 832, 852]


def test_similarities(spark):
    c = BloomConfig(1024, 15, kind="qgrams", q=4)
    df = spark.createDataFrame([("David", "Daniel")], "a string, b string").select(encode(F.col("a"), c).alias("a"), encode(F.col("b"), c).alias("b"))
    pa, pb = packed(F.col("a"), 1024), packed(F.col("b"), 1024)
    r = df.select(shared_bits(pa, pb).alias("i"), F.size("a").alias("na"), F.size("b").alias("nb"), different_bits(pa, pb).alias("x"))
    r = r.select("i", "na", "nb", "x", *[F.round(similarity(m, F.col("i"), F.col("na"), F.col("nb"), 1024), 6).alias(m) for m in ("dice", "jaccard", "cosine", "scm")]).first()
    assert (r["i"], r["na"], r["nb"], r["x"]) == (5, 60, 73, 123)
    assert (r["dice"], r["jaccard"], r["cosine"], r["scm"]) == (0.075188, 0.039063, 0.07555, 0.879883)


def test_chunk_keys(spark):
    assert sorted(one(spark, chunk_keys(F.array(*[F.lit(x) for x in (1, 3, 17, 40)]), 16))) == ["0,1,3", "1,17", "2,40"]


def test_configurations_are_unique():
    pool = ("a", "b", "c")
    found = X.random_configurations(pool, 50, 1, 3, 1)
    assert len(found) == len(set(found)) == 7
    assert len(list(X.qi_subsets(pool, (1, 2)))) == 6
