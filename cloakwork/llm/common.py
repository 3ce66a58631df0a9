"""Shared pieces of the training-data operators: tables in the shared folder, components, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}

#: ASCII white space that ends a word: space and \x09-\x0D, as bytes.split() has it.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset: a temporary folder in local mode; on a cluster an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIR:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="cloakwork-")
        found = _OWN_DIR[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/cloakwork-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cloakwork_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_cloakwork_path", None):
            drop_path(t.sparkSession, path)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): (id, component_id = smallest id reachable).

    Alternating large-star and small-star steps. Each node's minimum comes from a partial
    aggregate and goes back by a join whose hot keys Spark can split; no group of neighbours
    is ever gathered. Ids without an edge are not returned; null ends and loops count as none.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        nb = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = nb.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        j = nb.join(least, "a")
        if large:
            out = j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def done(e: DataFrame) -> bool:
        """Whether every edge goes from a node with no other edge up to a root."""
        child = e.groupBy("a").agg(F.count("*").alias("n"))
        rows = child.select("a", F.col("n"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("a")).distinct().select("a", F.lit(1).alias("n"), F.lit(1).alias("up")))
        bad = rows.groupBy("a").agg(F.max("n").alias("n"), F.count("*").alias("k"))
        return bad.filter("n > 1 or k > 1").isEmpty()

    start = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    now = written(start.filter("a is not null and b is not null and a <> b").distinct(), tag)
    while not done(now):
        step = written(stars(stars(now, True), False), tag)
        dropped(now)
        now = step
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    )


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over uint64."""
    h = h.copy()
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class WordHasher:
    """64-bit hashes of the lower-cased (A-Z) words of many texts at once, in numpy.

    Memory holds for one piece of about a megabyte, cut at white space, whatever the length of a text.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        self.power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, self.base, np.uint64), dtype=np.uint64)))
        self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, pow(self.base, -1, 1 << 64), np.uint64), dtype=np.uint64)))

    def piece(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of one piece."""
        b = _LOWER[np.frombuffer(raw, np.uint8)]
        word = ~_SPACE[b]
        starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
        if not len(starts):
            return starts, np.empty(0, np.uint64)
        if len(b) >= len(self.power):
            self.grow(len(b))
        values = self.table[b] * self.power[: len(b)]
        values[~word] = 0
        return starts, mix(np.add.reduceat(values, starts) * self.inverse[starts])

    def long(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of one text of any length."""
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + _PIECE)
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
            out.append(self.piece(raw[at:end])[1])
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def texts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The word hashes of each text, in order."""
        at = 0
        while at < len(texts):
            size, end = len(texts[at]), at + 1
            if size > _PIECE:
                yield self.long(texts[at])
                at = end
                continue
            while end < len(texts) and size + len(texts[end]) < _PIECE:
                size += len(texts[end]) + 1
                end += 1
            own = texts[at:end]
            starts, hashes = self.piece(b" ".join(own))
            begins = np.cumsum([0] + [len(t) + 1 for t in own])
            cuts = np.searchsorted(starts, begins)
            for i in range(len(own)):
                yield hashes[cuts[i] : cuts[i + 1]]
            at = end


def other_columns(df: DataFrame, new: tuple[str, ...]) -> tuple[DataFrame, str]:
    """``df`` without the columns that clash with the ``new`` names (as the session compares names), and the DDL of what is left."""
    same = (lambda c: c) if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    taken = {same(c) for c in new}
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    own = df.select(*[F.col(quoted(c)) for c in df.columns if same(c) not in taken])
    return own, ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in own.schema)


def slices(batches: Iterator, text_at: int, size: int = 4 << 20) -> Iterator:
    """Arrow batches cut so that the texts of column ``text_at`` take about ``size`` bytes: memory holds for a slice, or the longest text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_at).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths), 0
        while at < len(lengths):
            before = ends[at] - lengths[at]
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column in UTF-8; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
