"""Bloom-filter positions as column expressions, and similarities of bit sets."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X


@dataclass(frozen=True)
class BloomConfig:
    """size: bits of a filter; hashes: positions of a gram; kind: string, qgrams, skipgrams, tokens or phonetic."""

    size: int = 1024
    hashes: int = 20
    offset: int = 0
    kind: str = "qgrams"
    q: int = 5
    salt: str = ""

    def __post_init__(self):
        if self.kind not in ("string", "qgrams", "skipgrams", "tokens", "phonetic"):
            raise ValueError(f"unknown encoding: {self.kind}")
        if self.size < 1 or self.size >= 1 << 30 or self.hashes < 1 or self.q < 1:
            raise ValueError("size, hashes and q must be positive")


def _little_endian(hexed: Column, first: int, count: int) -> Column:
    """Hex digits of the integer that ``count`` bytes from ``first`` make, least byte first."""
    return F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(first, first + count))])


def _modulo(hexed: Column, digits: int, m: int) -> Column:
    """A hex integer modulo m, by groups of 8 digits."""
    out = F.lit(0).cast("long")
    for at in range(1, digits, 8):
        out = (out * F.lit(1 << 32) + F.conv(F.substring(hexed, at, 8), 16, 10).cast("long")) % m
    return out


def double_hashed(gram: Column, c: BloomConfig) -> Column:
    """Positions (h1 + j * h2) mod size of the two halves of the gram's SHA-256, which is taken once."""
    hexed = F.array(F.sha2(F.concat(gram, F.lit(c.salt)), 256))
    pair = F.transform(hexed, lambda h: F.struct(_modulo(_little_endian(h, 0, 16), 32, c.size).alias("a"), _modulo(_little_endian(h, 16, 16), 32, c.size).alias("b")))
    return F.flatten(F.transform(pair, lambda h: F.array(*[((h["a"] + j * h["b"]) % c.size + c.offset).cast("int") for j in range(c.hashes)])))


def segmented(value: Column, c: BloomConfig) -> Column:
    """Positions of the 4-byte segments of the value's SHA-256; there are only 7 different ones."""
    hexed = F.array(F.sha2(value, 256))
    return F.flatten(F.transform(hexed, lambda h: F.array(*[(_modulo(_little_endian(h, i * 4, 4), 8, c.size) + c.offset).cast("int") for i in range(min(7, c.hashes))])))


def encode(value: Column, c: BloomConfig) -> Column:
    """The sorted bit positions of a value; null is the empty text."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    wrapped = F.transform(X.tokens(value), lambda t: F.concat(F.lit("_"), t, F.lit("_")))
    salted = lambda v: F.array(*[F.concat(v, F.lit(f"{i}{c.salt}")) for i in range(c.hashes)])
    if c.kind == "string":
        sets = F.transform(salted(value), lambda v: segmented(v, c))
    elif c.kind == "tokens":
        sets = F.transform(F.flatten(F.transform(wrapped, salted)), lambda v: segmented(v, c))
    elif c.kind == "phonetic":
        from .phonetic import phonetic_positions

        return phonetic_positions(value, c)
    else:
        parts = wrapped if c.kind == "qgrams" else F.flatten(F.transform(wrapped, lambda t: F.array(X.every_second(t, True), X.every_second(t, False))))
        grams = F.array_distinct(F.flatten(F.transform(parts, lambda t: X.qgrams(t, c.q))))
        sets = F.transform(grams, lambda g: double_hashed(g, c))
    return F.sort_array(F.array_distinct(F.flatten(sets)))


def packed(bits: Column, size: int) -> Column:
    """The bit set as 64-bit words."""
    words = F.transform(F.sequence(F.lit(0), F.lit((size - 1) // 64)), lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int")))))
    return words


def _token_words(token: str, c: BloomConfig) -> list[int]:
    """The packed positions of all q-grams of ``_token_``."""
    wrapped = f"_{token}_".ljust(c.q, "_")
    out = [0] * ((c.size - 1) // 64 + 1)
    for g in {wrapped[i : i + c.q] for i in range(len(wrapped) - c.q + 1)}:
        h = hashlib.sha256((g + c.salt).encode()).digest()
        a, b = int.from_bytes(h[:16], "little"), int.from_bytes(h[16:], "little")
        for j in range(c.hashes):
            bit = (a + j * b) % c.size
            out[bit // 64] |= 1 << bit % 64
    return out


def with_words(df: DataFrame, value: str, c: BloomConfig, name: str = "words", most: int = 100_000) -> DataFrame:
    """``df`` with the packed positions of the column ``value``: ``packed(encode(value))``, with the grams of a token hashed once a task.

    most: tokens that a task remembers.
    """
    if c.kind != "qgrams" or c.offset:
        return df.withColumn(name, packed(encode(F.col(f"`{value}`"), c), c.size))
    n = (c.size - 1) // 64 + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known: dict[str, list[int]] = {}
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat = column.flatten().dictionary_encode()
            if len(known) > most:
                known.clear()
            own = flat.dictionary.to_pylist()
            for t in own:
                if t not in known:
                    known[t] = _token_words(t, c)
            table = np.array([known[t] for t in own] + [[0] * n], dtype=np.uint64)
            sizes = np.diff(column.offsets.to_numpy())
            # every row ends with the empty set, so that rows without tokens have one too
            ends = np.cumsum(sizes + 1)
            at = np.full(int(sizes.sum()) + len(sizes), len(own))
            inner = np.ones(len(at), dtype=bool)
            inner[ends - 1] = False
            at[inner] = flat.indices.to_numpy(zero_copy_only=False)
            words = np.bitwise_or.reduceat(table[at], ends - sizes - 1, axis=0) if len(sizes) else table[:0]
            lists = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * n, pa.array(words.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], name])

    tokens = X.tokens(F.coalesce(F.col(f"`{value}`").cast("string"), F.lit("")))
    return df.withColumn("__tokens", tokens).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))]))


def shared_bits(a: Column, b: Column, size: int | None = None) -> Column:
    """The number of common bits of two packed sets; with their ``size`` as one sum of words, which Spark compiles."""
    if size is not None:
        return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.get(b, F.lit(i)))) for i in range((size - 1) // 64 + 1)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def different_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def similarity(metric: str, both: Column, na: Column, nb: Column, size: int = 0, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """From the numbers of common bits and of bits of each side; empty sides give 0."""
    safe = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    if metric == "dice":
        return safe(2.0 * both, na + nb)
    if metric == "jaccard":
        return safe(1.0 * both, na + nb - both)
    if metric == "cosine":
        return safe(1.0 * both, F.sqrt((na * nb).cast("double")))
    if metric == "scm":
        return F.greatest(F.lit(0.0), (size - (na + nb - 2 * both)) / F.lit(float(size)))
    if metric == "tversky":
        return safe(1.0 * both, both + alpha * (na - both) + beta * (nb - both))
    raise ValueError(f"unknown metric: {metric}")


def chunk_keys(bits: Column, adjacent: int) -> Column:
    """Block keys: the bits of each run of ``adjacent`` positions that has any, after the run's number."""
    chunk = lambda b: F.floor(b / adjacent).cast("int")
    return F.transform(F.array_distinct(F.transform(bits, chunk)), lambda n: F.concat_ws(",", n.cast("string"), F.transform(F.filter(bits, lambda b: chunk(b) == n), lambda b: b.cast("string"))))
