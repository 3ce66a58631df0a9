"""The corpus pipeline: language ID, exact dedup, near-dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. Rows with a null doc_id go through all stages that can decide about their text. Empty
tables give empty tables. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import langid, mixing, sentencepiece_codec
from cloakwork.llm.common import written
from cloakwork.llm.exact_dedup import exact_dedup
from cloakwork.llm.minhash import minhash_dedup
from cloakwork.llm.queries import PIECES

#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.5
#: Words in a shingle of the near-duplicate stage.
WORDS = 5


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _same(docs: DataFrame) -> list:
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def _staying(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are kept in ``decided``; null ids compare equal."""
    own, sha = _free(docs, "__keep"), _free(docs, "__sha256")
    keep = decided.filter("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).distinct()
    text = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep[own]) & (text == keep[sha]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts among them) or with no sure language.

    The model learns from the rows that are not held out. If no row has a language, only texts without a letter go.
    """
    model = langid.train(docs.filter(~langid.held_out("doc_id")))
    if not model.langs:
        letter = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
        return docs.filter(letter)
    lang, score = _free(docs, "__lang"), _free(docs, "__score")
    found = langid.predict(docs, model, pred_col=lang, score_col=score)
    return found.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*_same(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; rows that repeat id and text stay once."""
    return _staying(docs, exact_dedup(docs)).dropDuplicates(["doc_id", "text"])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the row with the smallest doc_id stays."""
    return _staying(docs, minhash_dedup(docs, words=WORDS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0, 1 or 2 times): whole documents, rounded from words taken.

    Rows that share a doc_id are taken as often as the one taken most.
    """
    taken = mixing.mix(docs).filter("size > 0")
    own, times, copy = _free(docs, "__id"), _free(docs, "__times"), _free(docs, "__copy")
    uses = taken.select(F.col("doc_id").alias(own), F.round(F.col("taken") / F.col("size")).cast("int").alias(times))
    uses = uses.filter(F.col(times) > 0).groupBy(own).agg(F.max(times).alias(times))
    out = docs.join(uses, docs["doc_id"].eqNullSafe(uses[own]))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*_same(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, which give back the text."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.vocabulary(PIECES))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the language model, the mix and the tokens.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
