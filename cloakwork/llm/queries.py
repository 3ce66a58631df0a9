"""The queries opN_<name> and their DuckDB SQL. Each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, lm_scoring, mixing, quality, sentencepiece_codec, urlfilter, warc
from .exact_dedup import exact_dedup
from .forest import forest_dedup
from .minhash import minhash_dedup

#: The model file of the SentencePiece query.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.train(docs))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(_table(spark, sf_dir, "documents"), words=2)


def op4_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_dedup(_table(spark, sf_dir, "embeddings"))


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(_table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, sentencepiece_codec.vocabulary(PIECES), keep_text=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_lm_scoring, op2_exact_dedup, op3_minhash_dedup, op4_embedding_forest, op5_quality_resampling, op6_language_id, op7_source_mix, op8_url_filter, op9_sentencepiece, op10_warc)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": EXACT_SQL, "op4_embedding_forest": FOREST_SQL, "op8_url_filter": urlfilter.URL_SQL, "op10_warc": warc.WARC_SQL}


EXACT_SQL = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

FOREST_SQL = """
    WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id)
    SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
           (SELECT min(c) FROM reach r WHERE r.id = e.vec_id) AS component_id,
           (SELECT min(c) FROM reach r WHERE r.id = e.vec_id) = e.vec_id AS kept
    FROM embeddings e"""
