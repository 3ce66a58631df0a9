"""Near duplicates by bottom-k sketches.

Every text gives its set of word shingles and, from one hash function, a sketch: the k smallest
hashes of the set. Inverted lists of retained values give pairs and their overlaps; the sketch of
the union, which two sketches determine, estimates the Jaccard similarity and filters; what
passes is confirmed on the full sets of the texts' own shingles.

*Nodes.* Texts with the same sequence of lower-cased words are one node (128 bits of BLAKE2b stand for the
sequence); all other texts are compared, those whose shingle hashes are equal too. n_shingles counts 63-bit hashes.

*Which values are listed.* Of a linked pair (similarity 0.8 or more) the sketches of 80 values
share 64 on average; that they share fewer than 48 has a probability of about 1e-5 for a pair exactly at
0.8, far less above. So a pair must meet in the 33 values that are rarest over all documents, and only those are listed: a common
word pair or a shared passage is listed only for texts that hold little else. Values that occur
once are counted but never listed. Texts of fewer than 80 shingles have them all as a sketch.

*Large groups.* In each list all nodes are first paired with one
pivot (the smallest, then a random one, another in each list), and what is confirmed gives
components. Lists whose nodes are all in one component are done. In the others each node outside the list's largest
component meets all nodes of other components. Lists with few such pairs (up to ``CROSS`` for each node) give them
from the sketches. For nodes in lists with more of them (many texts around one passage, or the stragglers of a large
group) the whole sets are listed, with exact bounds: a linked pair of sizes m and n shares at
least s / (1 + s) * (m + n) shingles, so a value is listed only for partner sizes with which the values from it on can be
enough. A straggler of a group differs from all others by rare shingles, which use up that prefix, so it is in few long lists. Entries of these
carry the parities of their whole sets: sets that differ in more of them than links may differ in values are no pair, so the join
itself leaves out nearly all pairs of stragglers of texts up to some 3,000 shingles, and never a link.
So a group of n near copies costs about n pairs, and no link that would change a component is left out but by the
estimates (``SPREAD`` standard deviations). Long lists are dealt over several tasks.

*A pair across components* meets in many lists, as near copies below the similarity share most values.
Each entry of a list therefore carries the ``BEFORE`` values that precede it in the text's own order of rarity: if
two entries have one of them in common, the pair meets in that list too and is left to it. Entries of lists by sketch also
carry the sketch in 16 bits a value, so the join itself counts the common ones (at times one too many, never one too few);
only pairs that may be links leave it, and go on to the sketch of the union.

Nulls count as empty texts; texts without words link with nothing. Rows with a null id come back
with component_id null and kept true. Rows that repeat an id are documents of their own, each linked by its own text. Columns
of ``docs`` other than the id and the text are not read, so their names can clash with nothing. Texts of any length are taken whole;
ties (equal values, sizes) go by node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, components, dropped, mix, slices, utf8, written

SKETCH = 80
#: Standard deviations below the mean at which a link may be lost: 48 of 80 values at similarity 0.8.
SPREAD = 4.4722
#: Values of the same text that an entry of a list carries.
BEFORE = 8
WORDS = 5
SIMILARITY = 80
#: Pairs across components for each node of a list, up to which a list gives them all.
CROSS = 16
#: Step between size classes of whole sets.
CLASS_STEP = 1.03
#: Words of 64 bits with the parities of a whole set.
PARITY = 32
#: Entries of a list, or partners of a text, that one task takes.
PART = 4096
#: Bits of the map of wanted ids.
MAP_BITS = 1 << 24


def shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of a word sequence."""
    if not len(hashes):
        return hashes.astype(np.int64)
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = np.sort(mix(h) >> np.uint64(1))
    return h[np.concatenate(([True], h[1:] != h[:-1]))].astype(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, k: int) -> DataFrame:
    """(id, n_shingles, SHA-256 of the text, hash of its words in sequence, sketch) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches, 1):
            raw = utf8(batch.column(1))
            sizes, kept = [], []
            for h in hasher.texts(raw):
                own = shingle_set(h, words)
                sizes.append(len(own))
                kept.append(own[:k])
            offsets = np.cumsum([0] + [len(x) for x in kept]).astype(np.int32)
            flat = np.concatenate(kept) if kept else np.empty(0, np.int64)
            seq = [hashlib.blake2b(b" ".join(_words(x)), digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array(seq, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                names=["id", "n", "sha", "seq", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, sha binary, seq binary, sketch array<long>")


def least_shared(similarity: int, k: int) -> int:
    """Common values among the k of the union's sketch, which both sketches hold: ``SPREAD`` standard deviations below the mean."""
    s = similarity / 100
    return max(1, math.ceil(k * s - SPREAD * math.sqrt(k * s * (1 - s))))


def _shared_needed(m: Column, similarity: int, k: int) -> Column:
    """The number of values that two linked sketches share at least, one of them of m values.

    Below k the sketch is the whole set: exactly the share s of it if the other set is whole too; the
    other set can be larger than k, then k - (1 - s) * m / s of its k retained values are in this one.
    """
    whole = F.least(F.ceil(m * similarity / F.lit(100)), F.ceil(F.lit(float(k)) - m * (100 - similarity) / F.lit(similarity)))
    return F.greatest(F.when(m < k, whole).otherwise(F.lit(least_shared(similarity, k))), F.lit(1)).cast("int")


def listed(nodes: DataFrame, similarity: int, k: int) -> DataFrame:
    """The inverted lists: (id, n, value, before) for the rarest retained values of each node."""
    entries = nodes.select("id", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    shared = written(entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "op3-shared")
    per = entries.join(shared, "value").groupBy("id", "n", "m").agg(F.collect_list(F.struct("df", "value")).alias("common"))
    # singles come first in the order of rarity, so they use up the prefix
    out = written(_rarest(per, F.col("m") - _shared_needed(F.col("m"), similarity, k) + 1 - (F.col("m") - F.size("common"))), "op3-lists")
    dropped(shared)
    return out


def _rarest(per: DataFrame, take: Column) -> DataFrame:
    """(id, n, value, before): the first ``take`` of the shared values of each node in the order of rarity."""
    firsts = F.slice(F.sort_array("common"), F.lit(1), F.col("take"))["value"]
    per = per.withColumn("take", take.cast("int")).filter("take > 0").select("id", "n", firsts.alias("firsts"))
    each = per.select("id", "n", "firsts", F.posexplode("firsts").alias("at", "value"))
    before = F.slice("firsts", F.greatest(F.col("at") - BEFORE + 1, F.lit(1)), F.least("at", F.lit(BEFORE)))
    return each.select("id", "n", "value", before.alias("before"))


def sized(na: Column, nb: Column, similarity: int) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * similarity


def estimated(pairs: DataFrame, nodes: DataFrame, k: int, similarity: int) -> DataFrame:
    """Pairs (a, b) that the sketch of the union leaves possible."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
    j = pairs.join(side("b"), "b").join(side("a"), "a")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(F.col("sa"), F.col("sb")), F.col("union")))
    j = j.withColumn("union", union)
    size, s = F.least(F.size("union"), F.lit(k)), similarity / 100
    return j.filter(both >= size * s - F.sqrt(size * s * (1 - s)) * SPREAD).select("a", "b")


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # bytes: A-Z only, and ASCII white space


def _shingles(raw: bytes, words: int) -> set:
    w = _words(raw)
    if len(w) < words:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(words)), strict=False))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity. texts: (id, text) of all ids in pairs.

    The text of a comes once for each ``PART`` partners, before them in sorted order, so a task holds two texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set = set()
        for batch in slices(batches, 2):
            left, right = [], []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                other = _shingles(raw, words)
                if b is None:
                    own = other
                    continue
                inter = len(own & other)
                if inter and 100 * inter >= similarity * (len(own) + len(other) - inter):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    own = texts.select(F.col("id").alias("k"), "text")
    partners = dealt.join(own, F.col("b") == F.col("k")).select("a", "part", "b", "text")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(own, F.col("a") == F.col("k"))
    rows = heads.select("a", "part", F.lit(None).cast("long").alias("b"), "text").unionByName(partners)
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(run, "a long, b long")


def wanted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``rows`` joined with ``ids`` (distinct by id) on the id.

    A map of ``MAP_BITS`` bits of the ids (a broadcast of 8 MB at most, whatever their number) first
    drops most other rows where they are read, so hardly more than the wanted ones is shuffled.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    bit = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    marks = ids.select(F.floor(place / 64).alias("word"), bit().alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    maybe = rows.withColumn("word", F.floor(place / 64)).withColumn("bit", bit()).join(F.broadcast(marks), "word").filter(F.col("bit").bitwiseAND(F.col("bits")) != 0)
    # an inner join: the optimizer moves a semi-join below the map, and then all rows are shuffled
    return maybe.select(*rows.columns).join(ids, "id")


def texts_of(nodes: DataFrame, reps: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
    """(id, text) of nodes (id), written: of the rows with the node's doc_id the one with its very text."""
    need = written(nodes.join(reps.select("id", "doc", "sha"), "id").select(F.col("id").alias("node"), F.col("doc").alias("id"), "sha"), f"{tag}-need")
    marks = need.select("id").distinct()
    found = wanted(texts, marks).withColumn("own", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    own = found.alias("t").join(need.alias("n"), (F.col("t.id") == F.col("n.id")) & (F.col("own") == F.col("n.sha")))
    out = written(own.select(F.col("node").alias("id"), "text").dropDuplicates(["id"]), f"{tag}-texts")
    dropped(need)
    return out


class _Corpus:
    """What all steps read: the nodes (id, n, sketch, doc, sha), the texts (id: doc_id, text), the parameters."""

    def __init__(self, reps: DataFrame, texts: DataFrame, words: int, similarity: int, k: int):
        self.reps, self.texts, self.words, self.similarity, self.k = reps, texts, words, similarity, k

    def linked(self, pairs: DataFrame, estimate: bool = True) -> DataFrame:
        """The links among candidate pairs (a, b), written."""
        if estimate:
            pairs = estimated(pairs, self.reps, self.k, self.similarity)
        maybe = written(pairs, "op3-maybe")
        if maybe.isEmpty():
            return maybe
        ids = maybe.select(F.col("a").alias("id")).unionByName(maybe.select(F.col("b").alias("id"))).distinct()
        own = texts_of(ids, self.reps, self.texts, "op3")
        out = written(confirmed(maybe, own, self.words, self.similarity), "op3-links")
        dropped(maybe, own)
        return out


def placed(lists: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """The entries of lists that hold more than one component, with c (the component), minor (not the list's largest one), parts and many.

    parts: the number of tasks that the list is dealt over; many: more than ``CROSS`` pairs across components a node.
    """
    own = written(lists.join(parts, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id"), "op3-own")
    per = own.groupBy(*keys, "c").agg(F.count("*").alias("m"))
    per = per.groupBy(*keys).agg(F.count("*").alias("parties"), F.sum("m").alias("all"), F.max(F.struct("m", "c")).alias("most")).filter("parties > 1")
    minor = F.col("all") - F.col("most.m")
    mixed = per.select(*keys, F.col("most.c").alias("top"), F.ceil(F.col("all") / PART).alias("parts"), (minor > CROSS).alias("many"))
    out = written(own.join(mixed, keys).withColumn("minor", F.col("c") != F.col("top")).drop("top"), "op3-mixed")
    dropped(own)
    return out


def with_pivots(own: DataFrame, number: int, similarity: int) -> DataFrame:
    """Pairs (a, b) of a random node of each list and all its nodes in other components."""
    key = F.xxhash64("value", "id", F.lit(number))
    pivots = own.groupBy("value").agg(F.min(F.struct(key.alias("o"), "id", "c", "n")).alias("x")).select("value", F.col("x.id").alias("p"), F.col("x.c").alias("pc"), F.col("x.n").alias("pn"))
    met = own.join(pivots, "value").filter((F.col("c") != F.col("pc")) & sized(F.col("n"), F.col("pn"), similarity))
    return met.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def enough_shared(na: Column, nb: Column, common: Column, similarity: int, k: int) -> Column:
    """Whether sketches with so many common values can be those of linked sets.

    A linked pair has i >= s / (1 + s) * (na + nb) common shingles, s the similarity. If both sets are whole in their
    sketches, so are these; else a common value must be in both sketches, as those of the union's sketch are.
    """
    least = (na + nb) * similarity / F.lit(100.0 + similarity)
    return common >= F.when(F.greatest(na, nb) <= k, least - 1e-9).otherwise(F.lit(float(least_shared(similarity, k))))


def _meeting(left: DataFrame, right: DataFrame, keys: list[str], met: Column) -> DataFrame:
    """Entries of ``left`` with those of ``right`` (columns end in 2) in the same list. Every part of a list meets all of left's entries."""
    part = F.pmod(F.xxhash64("id"), "parts")
    x = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    y = right.withColumn("part", part).drop("parts")
    y = y.select(*[F.col(c).alias(f"{c}2") for c in y.columns])
    same = F.col("part") == F.col("part2")
    for key in keys:
        same = same & (F.col(key) == F.col(f"{key}2"))
    apart = (F.col("c") != F.col("c2")) & ~F.arrays_overlap("before", "before2")
    out = x.join(y, same & apart & met)
    return out.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def with_marks(own: DataFrame, corpus: _Corpus) -> DataFrame:
    """The entries with 16 bits of each value of their node's sketch, written."""
    short = F.transform("sketch", lambda v: (v.bitwiseAND(F.lit(0xFFFF).cast("long")) - 0x8000).cast("smallint"))
    marks = wanted(corpus.reps.select("id", "sketch"), own.select("id").distinct()).select("id", short.alias("marks"))
    return written(own.join(marks, "id"), "op3-sides")


def across(x: DataFrame, corpus: _Corpus) -> DataFrame:
    """All pairs (a, b) that share a value, are in different components and may be links by what their sketches share."""
    # values of a text that agree in their 16 bits count each, so that no common value is lost
    common = F.size(F.array_intersect("marks", "marks2")) + F.size("marks") - F.size(F.array_distinct("marks"))
    once = ~F.col("minor2") | (F.col("id") < F.col("id2"))
    met = once & sized(F.col("n"), F.col("n2"), corpus.similarity) & enough_shared(F.col("n"), F.col("n2"), common, corpus.similarity, corpus.k)
    return _meeting(x.filter("minor"), x, ["value"], met).distinct()


def _class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(CLASS_STEP)).cast("int")


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 * ``PARITY`` classes of hashes whether the set has an odd number of them, as bits of int64."""
    return np.packbits(np.bincount(shingles % (64 * PARITY), minlength=64 * PARITY).astype(np.uint8) & 1).view(np.int64)


def whole_lists(ids: DataFrame, corpus: _Corpus) -> tuple[DataFrame, DataFrame]:
    """(id, n, at, value, class, before, home): the lists of the whole shingle sets of these nodes, by size class of the partner. And (id, parity).

    An entry at a place from which r values are left is listed for partners of sizes from s * n to
    r * (1 + s) / s - n, and not above n: of a pair the larger set looks for the smaller one, which is at home in its own class.
    """
    words, s = corpus.words, corpus.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches, 1):
            sets = [shingle_set(h, words) for h in hasher.texts(utf8(batch.column(1)))]
            offsets = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY), pa.array(np.concatenate([parity(x) for x in sets]) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())), bits], names=["id", "n", "shingles", "parity"])

    texts = texts_of(ids, corpus.reps, corpus.texts, "op3-many")
    made = written(texts.mapInArrow(run, "id long, n long, shingles array<long>, parity array<long>"), "op3-whole")
    entries = made.select("id", "n", F.explode("shingles").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    per = entries.join(shared, "value").groupBy("id", "n").agg(F.collect_list(F.struct("df", "value")).alias("common"))
    # single values come first: they use up places, but are in no list
    take = F.col("n") - F.ceil(F.col("n") * s / F.lit(100)) + 1 - F.col("singles")
    per = per.withColumn("singles", F.col("n") - F.size("common")).withColumn("take", take.cast("int")).filter("take > 0")
    per = per.select("id", "n", "singles", F.slice(F.sort_array("common"), F.lit(1), F.col("take"))["value"].alias("firsts"))
    each = per.select("id", "n", "singles", "firsts", F.posexplode("firsts").alias("i", "value"))
    before = F.slice("firsts", F.greatest(F.col("i") - BEFORE + 1, F.lit(1)), F.least("i", F.lit(BEFORE)))
    each = each.select("id", "n", (F.col("singles") + F.col("i") + 1).alias("at"), "value", before.alias("before"))
    most = F.least(F.floor((F.col("n") - F.col("at") + 1) * (100 + s) / F.lit(s) + 1e-9) - F.col("n"), F.col("n"))
    least = F.ceil(F.col("n") * s / F.lit(100))
    classes = each.withColumn("most", most).filter(F.col("most") >= least).withColumn("class", F.explode(F.sequence(_class(least), _class(F.col("most")))))
    home = (F.col("class") == _class(F.col("n"))) & (F.col("most") >= F.col("n"))
    out = written(classes.withColumn("home", home).drop("most"), "op3-whole-lists")
    parities = written(made.select("id", "parity"), "op3-parity")
    dropped(made, texts)
    return out, parities


def across_whole(own: DataFrame, corpus: _Corpus) -> DataFrame:
    """All pairs (a, b) of different components that can be links by their sizes, the places of a shared value and their parities.

    Sets of sizes m and n are linked if they differ in (1 - s) / (1 + s) * (m + n) values at most, and each parity that differs takes one of these.
    """
    s = corpus.similarity
    least = (F.col("n") + F.col("n2")) * s / F.lit(100.0 + s) - 1e-9
    left = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) + 1
    apart = F.aggregate(F.zip_with("parity", "parity2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    near = apart <= (F.col("n") + F.col("n2")) * (100 - s) / F.lit(100.0 + s) + 1e-9
    looks = lambda x, y: (F.col(f"n{x}") > F.col(f"n{y}")) | ((F.col(f"n{x}") == F.col(f"n{y}")) & (F.col(f"id{x}") > F.col(f"id{y}")))
    keys = ["value", "class"]
    fits = lambda x, y: sized(F.col("n"), F.col("n2"), s) & (left >= least) & looks(x, y) & near
    found = _meeting(own.filter("minor"), own.filter("home"), keys, fits("", "2"))
    found = found.unionByName(_meeting(own.filter("home and minor"), own.filter("not minor"), keys, fits("2", "")))
    return found.distinct()


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY, k: int = SKETCH) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept, text_sha256."""
    made = written(sketches(docs, id_col, text_col, words, k), "op3-sketches")
    sets = made.filter("id is not null and n > 0")
    per_node = sets.groupBy("seq").agg(F.min(F.struct("id", "sha", "n", "sketch")).alias("x"), F.count("*").alias("rows"))
    reps = per_node.select("seq", "rows", F.col("x.id").alias("doc"), "x.sha", "x.n", "x.sketch")
    # written once, so the numbers of nodes never change
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()), "op3-nodes")
    whole, made = made, written(made.select("id", "n", "seq", "sha"), "op3-rows")
    dropped(whole)
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    corpus = _Corpus(reps, texts, words, similarity, k)
    lists = listed(reps.select("id", "n", "sketch"), similarity, k)
    least = written(lists.groupBy("value").agg(F.min(F.struct("id", "n")).alias("x"), F.max("id").alias("hi")).filter("x.id < hi").select("value", F.col("x.id").alias("a"), F.col("x.n").alias("na")), "op3-least")
    stars = lists.join(least, "value").filter((F.col("id") != F.col("a")) & sized(F.col("n"), F.col("na"), similarity))
    links = [corpus.linked(stars.select("a", F.col("id").alias("b")).distinct())]
    dropped(least)
    parts = _parts(links)
    own = placed(lists, parts, ["value"])
    if not own.isEmpty():
        links.append(corpus.linked(with_pivots(own, 1, similarity)))
        dropped(own, parts)
        parts = _parts(links)
        own = placed(lists, parts, ["value"])
        sides = with_marks(own.filter("not many"), corpus)
        links.append(corpus.linked(across(sides, corpus)))
        dropped(sides)
        ids = written(own.filter("many").select("id").distinct(), "op3-many")
        if not ids.isEmpty():
            more, parities = whole_lists(ids, corpus)
            crossing = placed(more, parts, ["value", "class"])
            sides = written(crossing.join(parities, "id"), "op3-sides")
            links.append(corpus.linked(across_whole(sides, corpus), estimate=False))
            dropped(more, parities, crossing, sides)
        dropped(parts, ids)
        parts = _parts(links)
    dropped(own, lists)
    # the smallest doc_id of a component; a node of one row with no link is alone
    named = reps.join(parts, "id", "left").select("seq", "rows", "doc", "component_id", F.coalesce("component_id", "id").alias("c"))
    smallest = named.filter("component_id is not null").groupBy("c").agg(F.min("doc").alias("least"))
    grouped = named.filter("component_id is not null or rows > 1").join(smallest, "c", "left").select("seq", F.coalesce("least", "doc").alias("component_id"))
    out = made.join(written(grouped, "op3-grouped"), "seq", "left")
    alone = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("id"))
    comp = F.when(F.col("id").isNotNull(), alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("id").isNull() | (comp == F.col("id"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _parts(found: list[DataFrame]) -> DataFrame:
    return written(components(reduce(DataFrame.unionByName, found), "op3-cc"), "op3-parts")
