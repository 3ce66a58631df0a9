"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled (by a hash of the id) and laid end to end; the line of words
is cut into blocks of equal numbers of words. The schedule is a line of slots: slot i has the
golden-ratio point frac((i + 1) * 0.618...), which the cumulative weights map to a source, and the
slot's rank among its source's slots picks the block (rank modulo the number of blocks). So every
stretch of the schedule is close to the target weights, and no block is used a second time before
all others were used once.

*Targets.* Sources in code point order, null last, weigh ``weights`` in turn and share
``share`` times all sizes; a target stops at ``most`` times its source's size, and the excess goes
to the other sources by weight until none is above.

*Scale.* No source is ever in one task: documents and slots are ranked within small parts (a
hash range of a source; a run of slots), and the parts' totals are summed in a second step. Only
one row per source reaches the driver (more than ``MAX_SOURCES`` raise an error).

Size is the number of words ``[^\\x20\\x09-\\x0D]+`` of the text; null counts 0. Documents of size 0
and documents of a source whose target is 0 are taken 0 times. Rows with equal ids are documents of their own.
Columns other than the id, the text and the source are not read, so their names can clash with nothing; texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, written

GOLDEN = (5**0.5 - 1) / 2
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Words in a block, and the number of blocks that a source has at least (if it has as many words).
BLOCK_WORDS, LEAST_BLOCKS = 4096, 1024
MAX_SOURCES = 1_000_000
#: Sources up to which their plan, a row of numbers for each, is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
_RUN = 4096


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """The words that each source gives."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, open_, out = share * sum(sizes.values()), {s: weights[i % len(weights)] for i, s in enumerate(order)}, {}
    while open_:
        unit = left / sum(open_.values())
        above = [s for s in order if s in open_ and open_[s] * unit >= most * sizes[s]]
        if not above:
            return out | {s: w * unit for s, w in open_.items()}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def schedule(spark: SparkSession, plan: DataFrame, slots: int) -> DataFrame:
    """(slot, source_no, rank) of all slots. plan: source_no, lo, hi (its part of the unit interval), most."""
    line = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / _RUN).alias("run"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("point"))
    used = plan.filter("hi > lo").select("source_no", "lo", "hi")
    n, last = used.agg(F.count("*"), F.max("source_no")).first()
    cells = 1 << max(0, n - 1).bit_length() + 2
    # each source is listed under the cells of the unit interval that its part touches: cells and sources together at most
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    ends = used.withColumn("hi", F.when(F.col("source_no") == F.lit(last), F.lit(2.0)).otherwise(F.col("hi")))  # no point is beyond the last
    listed = ends.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    near = line.withColumn("cell", cell(F.col("point"))).join(F.broadcast(listed) if n <= BROADCAST_SOURCES else listed, "cell")
    dealt = near.filter((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).select("slot", "run", "source_no")
    of_run = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy("source_no", "run").agg(F.count("*").alias("n")).select("source_no", "run", F.coalesce(F.sum("n").over(of_run), F.lit(0)).alias("before"))
    inside = dealt.withColumn("k", F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1)
    return inside.join(runs, ["source_no", "run"]).select("slot", "source_no", (F.col("before") + F.col("k")).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken (words, repeats counted)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("order")), "op7-sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    words, number = {r["source"]: r["words"] for r in totals}, {r["source"]: r["docs"] for r in totals}
    goal = targets(words, weights, share, most)
    plan, at, slots = [], 0.0, 0.0
    want = {}
    for s in sorted(words, key=lambda s: (s is None, s or "")):
        blocks = min(words[s], max(LEAST_BLOCKS, -(-words[s] // block_words)))
        want[s] = (blocks, goal[s] * blocks / words[s] if words[s] else 0.0)
        slots += want[s][1]
    for i, (s, (blocks, share_of)) in enumerate(want.items()):
        hi = at + (share_of / slots if slots else 0.0)
        plan.append((i, s, int(words[s]), float(goal[s]), int(blocks), at, hi, 1 << max(0, math.ceil(math.log2(max(1, number[s] / 2048))))))
        at = hi
    plan = written(spark.createDataFrame(plan, "source_no int, source string, source_size long, target double, blocks long, lo double, hi double, parts int").coalesce(1), "op7-plan")
    few = F.broadcast(plan) if len(words) <= BROADCAST_SOURCES else plan
    placed = sized.join(few, sized["source"].eqNullSafe(plan["source"])).select("id", "order", "size", sized["source"], "source_no", "source_size", "target", "blocks", "parts")
    # where each document begins on its source's line: within its part, then the parts before
    placed = placed.withColumn("part", F.pmod(F.shiftrightunsigned("order", 20), F.col("parts").cast("long")))
    place = Window.partitionBy("source_no", "part").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("source_no", "part").agg(F.sum("size").alias("w")).select("source_no", "part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("offset"))
    lined = placed.withColumn("inner", F.coalesce(F.sum("size").over(place), F.lit(0))).join(parts, ["source_no", "part"]).withColumn("start", F.col("offset") + F.col("inner"))
    lined = written(lined.select("id", "source", "source_no", "size", "source_size", "target", "blocks", "start"), "op7-lined")
    dropped(sized)
    used = written(schedule(spark, plan, round(slots)), "op7-schedule")
    cap = few.select("source_no", "blocks")
    # a rank beyond most x blocks would use a block too often
    uses = used.join(cap, "source_no").filter(F.col("rank") < F.col("blocks") * int(most)).groupBy("source_no", F.pmod("rank", "blocks").alias("block")).agg(F.count("*").alias("uses"))
    first = F.expr("(start * blocks) div source_size")  # block j holds the words from ceil(j * source_size / blocks)
    last = F.expr("((start + size - 1) * blocks) div source_size")
    spans = lined.filter("size > 0").select("id", "start", "size", "source_no", "blocks", "source_size", F.explode(F.sequence(first, last)).alias("block"))
    begin = lambda j: F.ceil((j * F.col("source_size")) / F.col("blocks").cast("decimal(20,0)")).cast("long")
    held = spans.withColumn("words", F.least(F.col("start") + F.col("size"), begin(F.col("block") + 1)) - F.greatest(F.col("start"), begin(F.col("block"))))
    taken = held.join(uses, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    # documents of size 0 share their start with the next one, but take nothing
    out = lined.join(taken, ["source_no", "start"], "left")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))
