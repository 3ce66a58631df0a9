"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 characters of the lower-cased text, hashed to ``buckets``)
of every training row, by language: each task emits at most languages x buckets counts, and one
aggregation adds them up. The log-probability matrix, of that same bounded size, is broadcast;
scoring counts the n-grams of a batch of texts into a sparse document x bucket matrix and multiplies it with that one.

The prediction reads the text only. A text that is null or has no letter is ``und`` with score 0.
The score is the posterior of the predicted language where each n-gram counts for
1 / sqrt(number of n-grams) (a plain product of so many factors is always 0 or 1). Ties go to the
smaller language code. Without any training row every text is ``und``.

Texts of any length are lower-cased and counted in pieces of ``PIECE`` characters, cut after a space or line end where there
is one; n-grams across a cut are counted once. Rows that repeat are counted and predicted as often. Columns of the
input whose names clash with the new ones (also in another case, unless the session tells cases apart) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import other_columns, slices

BUCKETS = 1 << 14
#: The most languages that a model holds; more raise an error.
MAX_LANGUAGES = 1000
PIECE = 1 << 18
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Lower-cased characters of a text, and how many of them (two at most) the piece before ended with."""
    at, tail = 0, np.empty(0, np.uint32)
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
        own = np.concatenate((tail, np.frombuffer(text[at:end].lower().encode("utf-32-le"), np.uint32)))
        yield own, len(tail)
        at, tail = end, own[-2:]


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every 1-, 2- and 3-gram of characters that lies within a text."""
    found = [(i, x, known) for i, t in enumerate(texts) for x, known in pieces(t)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.array([len(x) for _, x, _ in found])
    chars = np.concatenate([x for _, x, _ in found]).astype(np.uint64)
    ends = np.cumsum(sizes)
    row = np.repeat([i for i, _, _ in found], sizes)
    last, new = np.repeat(ends, sizes), np.repeat(ends - sizes + [k for _, _, k in found], sizes)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    rows, of, code = [], [], np.zeros(len(chars), np.uint64)
    for g, odd in enumerate(_ODD, 1):
        n = len(chars) - g + 1
        if n <= 0:
            break
        code = (code[:n] + chars[g - 1 :] + np.uint64(1)) * np.uint64(odd)
        stop = np.arange(g, n + g)
        inside = (stop <= last[:n]) & (stop > new[:n])
        rows.append(row[:n][inside])
        mixed = code ^ (code >> np.uint64(29))
        of.append(((mixed * np.uint64(_ODD[0])) >> shift)[inside].astype(np.int64))
    return np.concatenate(rows), np.concatenate(of)


def sparse(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document x bucket matrix of the texts' n-gram counts: (document, bucket, count), in order."""
    rows, of = grams(texts, buckets)
    keys = np.sort(rows * buckets + of)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    n = np.diff(np.concatenate((new, [len(keys)])))
    return keys[new] // buckets, keys[new] % buckets, n


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class LanguageModel:
    """Languages in order, and the matrix of log P(bucket | language) with the log priors."""

    def __init__(self, langs: list[str], logs: np.ndarray, priors: np.ndarray):
        self.langs, self.logs, self.priors = langs, logs, priors

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text of a batch."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        doc, bucket, n = sparse(texts, len(self.logs))
        total, grams_of = np.tile(self.priors, (len(texts), 1)), np.zeros(len(texts))
        if len(doc):
            starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            total[doc[starts]] += np.add.reduceat(self.logs[bucket] * n[:, None], starts, axis=0)
            grams_of[doc[starts]] = np.add.reduceat(n, starts)
        best = total.argmax(axis=1)
        z = (total - total[np.arange(len(texts)), best][:, None]) / np.maximum(1.0, np.sqrt(grams_of))[:, None]
        scores = 1 / np.exp(z).sum(axis=1)
        return [(self.langs[b], float(s)) if has_letter(t) else ("und", 0.0) for t, b, s in zip(texts, best, scores, strict=True)]


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, alpha: float = 0.5) -> LanguageModel:
    """A model from all of ``rows``; rows with a null text or language teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        sums, docs = np.zeros((0, buckets), np.int64), np.zeros(0, np.int64)
        for batch in slices(batches, 0, 1 << 20):
            langs = [place.setdefault(x, len(place)) for x in batch.column(1).to_pylist()]
            if len(place) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
            if len(place) > len(sums):
                more = len(place) - len(sums)
                sums, docs = np.pad(sums, ((0, more), (0, 0))), np.pad(docs, (0, more))
            np.add.at(docs, langs, 1)
            doc, bucket, n = sparse(batch.column(0).to_pylist(), buckets)
            np.add.at(sums, (np.array(langs, np.int64)[doc], bucket), n)
        for lang, i in place.items():
            hit = np.flatnonzero(sums[i])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(hit) + 1), pa.string()), pa.array(np.append(hit, -1), pa.int64()), pa.array(np.append(sums[i][hit], docs[i]), pa.int64())], names=["lang", "bucket", "n"])

    usable = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    found = usable.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = found.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(table) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(r["lang"] for r in table)
    counts, docs = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    for r in table:
        at = langs.index(r["lang"])
        for bucket, n in r["x"]:
            if bucket < 0:
                docs[at] = n
            else:
                counts[bucket, at] = n
    logs = np.log(counts + alpha) - np.log(counts.sum(axis=0) + alpha * buckets) if langs else counts
    return LanguageModel(langs, logs, np.log(docs / docs.sum()) if langs else docs)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the prediction and its score; all other columns stay (columns of those two names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logs, model.priors))
    kept, schema = other_columns(docs, (pred_col, score_col))
    at = kept.columns.index(text_col)
    names = [*kept.columns, pred_col, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in slices(batches, at, 1 << 20):
            got = own.predict([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=names)

    return kept.mapInArrow(run, f"{schema}, `{pred_col}` string, `{score_col}` double")


def held_out(id_col: str = "doc_id"):
    """Rows that teach nothing: crc32 of the id as text leaves 2 when divided by 4. A null id's rows teach."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all: id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    found = predict(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model)
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
