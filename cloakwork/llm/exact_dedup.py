"""Exact duplicates by deterministic block naming, in DataFrame functions only.

Each text is cut into blocks of a fixed number of bytes. Distinct blocks that occur more than
once are sorted and get integer names; a text with a block that no other occurrence shares
equals no other text and leaves. Then adjacent names are paired, pairs that repeat are sorted
and named in the same way, and so on until every text left has one name. A name stands for one
byte string only: no hash takes part, so no collision can join two texts. (SHA-256 only tells
apart the texts of rows that repeat an id.)

Null text counts as empty; the empty text is one empty block. Rows whose id is null are
returned as kept, with keep_id null and group_size 1. Rows that repeat an id count as rows. Texts of
any length are taken whole; ties cannot occur (the largest id stays, and rows of one id and text are alike). Columns other than
the id and the text are not read, so their names can clash with nothing. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Bytes in a block of the first round.
BLOCK_BYTES = 8192


def _blocks(body: Column, size: Column, block: int) -> Column:
    last = F.greatest(F.ceil(size / F.lit(block)).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(body, i * block + 1, F.lit(block)))


def _named(occurrences: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Integer names for the values of ``keys`` that occur more than once.

    Equal values meet in one partition after a partial count; there they are sorted, and the
    name is the partition's number and the rank in it. Written at once, so names never change.
    """
    counted = occurrences.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return written(counted.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), tag)


def _row(id_col: str, body: Column) -> Column:
    """What stands for a row: its id, and its text, as an id can come with several. Ordered by id first."""
    return F.struct(F.col(id_col).alias("id"), F.unhex(F.sha2(body, 256)).alias("text"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """Tables (row_id, level, name), one for each round that finished some texts; texts of a (level, name) are equal.

    A row_id is the struct (id, text) of ``_row``; rows that repeat both are one entry with their number as copies.
    Only texts of which every block repeats are listed; all others are single.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.filter(F.col(id_col).isNotNull()).select(_row(id_col, body).alias("row_id"), body.alias("body"))
    parts = rows.select("row_id", F.octet_length("body").alias("size"), F.posexplode(_blocks(F.col("body"), F.octet_length("body"), block_bytes)).alias("pos", "block"))
    names = _named(parts.select("block"), ["block"], "op2-blocks")
    parts = parts.withColumn("n", F.greatest(F.ceil(F.col("size") / block_bytes), F.lit(1)))
    state = _gathered(parts.join(names, "block").select("row_id", "n", "pos", "name"), "op2-level0")
    dropped(names)
    done, level = [], 0
    while True:
        done.append(state.filter(F.size("names") == 1).select("row_id", F.lit(level).alias("level"), F.col("names")[0].alias("name"), "copies"))
        if state.filter(F.size("names") > 1).isEmpty():
            return done
        level += 1
        paired = state.filter(F.size("names") > 1).select(
            "row_id", "copies", F.ceil(F.size("names") / 2).alias("n"),
            F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1), lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b")))).alias("pos", "pair"),
        ).select("row_id", "copies", "n", "pos", "pair.a", "pair.b")
        # a row_id that stands for several equal rows counts as often
        pairs = paired.groupBy("a", "b").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
        names = written(pairs.sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()), f"op2-pairs{level}")
        state = _gathered(paired.join(names, ["a", "b"]).select("row_id", "n", "pos", "name", "copies"), f"op2-level{level}")
        dropped(names)


def _gathered(parts: DataFrame, tag: str) -> DataFrame:
    """The names of each text in order, of texts that have all of them; as many as the text has blocks."""
    given = "copies" in parts.columns
    at_pos = parts.groupBy("row_id", "n", "pos", "name").agg((F.max("copies") if given else F.count("*")).alias("copies"))
    whole = at_pos.groupBy("row_id", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("at"), F.max("copies").alias("copies"))
    return written(whole.filter(F.size("at") == F.col("n")).select("row_id", "copies", F.col("at.name").alias("names")), tag)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    from functools import reduce

    named = reduce(DataFrame.unionByName, identities(docs, id_col, text_col, block_bytes))
    groups = named.groupBy("level", "name").agg(F.max("row_id")["id"].alias("keep_id"), F.sum("copies").alias("group_size"))
    found = named.join(written(groups, "op2-groups"), ["level", "name"]).select("row_id", "keep_id", "group_size")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out = docs.select(_row(id_col, body).alias("row_id")).join(written(found, "op2-found"), "row_id", "left")
    own = F.col("row_id.id")
    return out.select(
        own.alias(id_col),
        F.coalesce("keep_id", own).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (own.isNull() | (F.coalesce("keep_id", own) == own)).alias("kept"),
        F.lower(F.hex("row_id.text")).alias("text_sha256"),
    )
