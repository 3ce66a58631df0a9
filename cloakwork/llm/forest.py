"""Embedding near duplicates by a forest of random-projection trees.

Every tree splits the unit vectors at the median of their projection on a random direction, again
and again; a vector near the median goes to both sides (within ``spill`` times the deviation of the
difference that a pair at the threshold has on a random direction). The top of the trees is fitted
on a bounded sample (``sample`` vectors with the smallest hashes) and indexes every vector. Leaves
that are still above ``leaf_rows`` vectors of one label are split on, in rounds over all data with
approximate medians, as long as that makes them smaller. Within the leaves vectors of one label are
compared in blocks by cosine in double precision; pairs at or above the threshold are links. A pair
that meets in several leaves counts in the first of them only, so a vector's links can be added up
over leaves, and a leaf gives a row for each vector, not for each pair.

*Recall.* With the default spill and 64 components a pair at the threshold is parted by a split with
a probability of about 0.4%, so a tree of 10 levels misses 4% of such pairs, and four trees together
miss about one in 100,000; vectors of few components lie closer to the medians and lose more.

*Large groups.* Equal vectors of a label are one node with a weight. Leaves that can't be made
smaller (a third of all vectors close to one another) are compared in blocks of ``leaf_rows``, each
pair of blocks a task of its own.

Vectors with a null label or id, null or zero vectors, and vectors with null or non-finite
components link with nothing; vectors of different lengths are not linked. Rows that repeat an id
count as vectors of their own in n_links. With a null id component_id is null and kept true. Components of any finite
size count (1e-200 as well as 1e200). Columns other than the id, the vector and the label are not read, so their names can clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, written

THRESHOLD = 0.98
TREES, SPILL = 4, 0.8
LEAF_ROWS, SAMPLE, MAX_DEPTH = 512, 20_000, 12
MAX_ROUNDS = 30


def _direction(seed: int, dim: int) -> np.ndarray:
    v = np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF).standard_normal(dim)
    return v / np.linalg.norm(v)


def margin(dim: int, threshold: float, spill: float) -> float:
    """How far from a median vectors of a length go to both sides."""
    return spill * (max(0.0, 2 - 2 * threshold) / dim) ** 0.5


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors; divided by the largest component first, so that no square is lost or infinite."""
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, trees: int, depth: int, spill: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and medians of the heap-ordered nodes of each tree, from unit vectors."""
    out = []
    for t in range(trees):
        dirs, cuts = np.zeros((1 << depth, sample.shape[1])), np.zeros(1 << depth)
        held = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            own = held.pop(node)
            dirs[node] = _direction(seed * 1_000_003 + t * 65_537 + node, sample.shape[1])
            p = sample[own] @ dirs[node]
            cuts[node] = np.median(p) if len(own) else 0.0
            held[2 * node], held[2 * node + 1] = own[p <= cuts[node] + spill], own[p > cuts[node] - spill]
        if not np.isfinite(cuts).all():
            raise ValueError("a median is not finite")
        out.append((dirs, cuts))
    return out


def leaves_of(x: np.ndarray, forest: list[tuple[np.ndarray, np.ndarray]], depth: int, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all rows; the leaves of tree t are t * 2^depth and on."""
    rows_of, leaves = [], []
    for t, (dirs, cuts) in enumerate(forest):
        rows, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(depth):
            p = np.einsum("ij,ij->i", x[rows], dirs[node]) - cuts[node]
            left, right = p <= spill, p > -spill
            rows, node = np.concatenate((rows[left], rows[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
        rows_of.append(rows)
        leaves.append(node - (1 << depth) + (t << depth))
    return np.concatenate(rows_of), np.concatenate(leaves)


def _assigned(nodes: DataFrame, forests: dict[int, list], depth: int, spill: dict[int, float]) -> DataFrame:
    """(id, kind, leaf) of all nodes; vectors of a length that no sample had are all in leaf 0."""
    shared = nodes.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, dims = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                if dim not in shared.value:
                    rows, leaf = own, np.zeros(len(own), np.int64)
                else:
                    rows, leaf = leaves_of(_unit(batch.column(3).take(pa.array(own)), dim), shared.value[dim], depth, spill[int(dim)])
                    rows = own[rows]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), kinds.take(pa.array(rows)), pa.array(leaf, pa.int64())], names=["id", "kind", "leaf"])

    return nodes.select("id", "kind", "dim", "v").mapInArrow(run, "id long, kind string, leaf long")


def _split_on(placed: DataFrame, nodes: DataFrame, spill: float, threshold: float, leaf_rows: int, seed: int) -> DataFrame:
    """Splits leaves above ``leaf_rows`` until none is left or a round makes them hardly smaller."""
    before = None
    for number in range(MAX_ROUNDS):
        counts = placed.groupBy("kind", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > leaf_rows)
        large = written(counts, "op4-large")
        total, most = large.agg(F.sum("n"), F.max("n")).first()
        if not total or (before is not None and most > 0.9 * before[1] and total > 0.9 * before[0]):
            return placed
        before = (total, most)
        there = placed.join(large.select("kind", "leaf"), ["kind", "leaf"], "left_semi").join(nodes.select("id", "v"), "id")

        def run(batches: Iterator[pa.RecordBatch], number=number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, dims = batch.column(2).to_numpy(), pc.list_value_length(batch.column(3)).to_numpy()
                p, near = np.empty(len(leaf)), np.empty(len(leaf))
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    own = own[np.argsort(leaf[own], kind="stable")]
                    x = _unit(batch.column(3).take(pa.array(own)), int(dim))
                    near[own] = margin(int(dim), threshold, spill)
                    ends = np.flatnonzero(np.diff(leaf[own])) + 1
                    for rows, part in zip(np.split(own, ends), np.split(x, ends), strict=True):
                        p[rows] = part @ _direction(int(leaf[rows[0]]) * 31 + number + seed, int(dim))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p), pa.array(near)], names=["id", "kind", "leaf", "p", "near"])

        shown = written(there.select("id", "kind", "leaf", "v").mapInArrow(run, "id long, kind string, leaf long, p double, near double"), "op4-shown")
        cuts = shown.groupBy("kind", "leaf").agg(F.percentile_approx("p", 0.5, 1000).alias("cut"))
        sides = F.filter(F.array(F.when(F.col("p") <= F.col("cut") + F.col("near"), 0), F.when(F.col("p") > F.col("cut") - F.col("near"), 1)), lambda s: s.isNotNull())
        new = shown.join(written(cuts, "op4-cuts"), ["kind", "leaf"]).select("id", "kind", F.col("leaf").alias("up"), F.explode(sides).alias("side"))
        # 2^62 leaves: of one number by chance only once in very many, which then are compared as one leaf
        new = new.select("id", "kind", F.shiftrightunsigned(F.xxhash64("up", "side", F.lit(number)), 2).alias("leaf")).distinct()
        placed, old = written(placed.join(large.select("kind", "leaf"), ["kind", "leaf"], "left_anti").unionByName(new), "op4-placed"), placed
        dropped(old, large, shown)
    return placed


def _compare(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        leaf = key[1].as_py()
        kinds = table.column("chunk").to_numpy()
        ci, cj = key[2].as_py(), key[3].as_py()
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        v = table.column("v").combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        x = _unit(v, len(v[0]))
        a, b = np.flatnonzero(kinds == ci), np.flatnonzero(kinds == cj)
        hit = x[a] @ x[b].T >= threshold
        if ci == cj:
            np.fill_diagonal(hit, False)
        ra, rb = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(ra):
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        hit = hit[np.ix_(ra, rb)]
        a, b = a[ra], b[rb]
        # leaves before this one that both rows are in: there the pair has counted
        place: dict[int, int] = {}
        lists = table.column("leaves").to_pylist()
        own = {int(i): [place.setdefault(z, len(place)) for z in lists[i] if z < leaf] for i in np.union1d(a, b)}

        def marks(rows: np.ndarray) -> np.ndarray:
            m = np.zeros((len(rows), max(1, len(place))), np.float32)
            for r, i in enumerate(rows):
                m[r, own[int(i)]] = 1
            return m

        counted = hit & ~(marks(a) @ marks(b).T > 0)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, counted @ weight[b])
        if ci != cj:
            np.add.at(links, b, weight[a] @ counted)
        root = _roots(ids, a, b, hit)
        own_rows = np.union1d(a, b)
        return pa.table({"id": ids[own_rows], "links": links[own_rows], "root": root[own_rows]})

    return run


def _roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches over hits."""
    root = ids.copy()
    while True:
        before = root.copy()
        big = np.iinfo(np.int64).max
        np.minimum.at(root, a, np.where(hit, root[b][None, :], big).min(axis=1))
        np.minimum.at(root, b, np.where(hit, root[a][:, None], big).min(axis=0))
        if (root == before).all():
            return root


def forest_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    v = F.col(vector_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("kind"), v.alias("v"), usable.alias("usable"))
    # 128 bits of two hashes stand for a vector when equal ones are put together
    rows = rows.withColumn("h1", F.when(F.col("usable"), F.xxhash64(F.lit(1), "v"))).withColumn("h2", F.when(F.col("usable"), F.xxhash64(F.lit(2), "v")))
    classes = rows.filter("usable").groupBy("kind", "h1", "h2").agg(F.min(F.struct("id", "v")).alias("x"), F.count("*").alias("weight"))
    nodes = written(classes.select("x.id", "kind", "h1", "h2", "weight", F.size("x.v").alias("dim"), "x.v"), "op4-nodes")
    per_kind = nodes.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(1, per_kind) / (leaf_rows / 2))))))
    drawn = nodes.select("dim", "v", F.xxhash64("id", F.lit(seed)).alias("o")).orderBy("o").limit(sample).toArrow()
    forests, margins, dims = {}, {}, drawn.column("dim").to_numpy()
    for dim in np.unique(dims):
        own = drawn.filter(pa.array(dims == dim)).column("v").combine_chunks()
        margins[int(dim)] = margin(int(dim), threshold, spill)
        forests[int(dim)] = fit(_unit(own.chunk(0) if isinstance(own, pa.ChunkedArray) else own, int(dim)), trees, depth, margins[int(dim)], seed)
    placed = written(_assigned(nodes, forests, depth, margins), "op4-placed")
    # the vector's length is part of its group
    placed = written(placed.join(nodes.select("id", "dim"), "id").select("id", F.concat_ws(":", "dim", "kind").alias("kind"), "leaf"), "op4-placed")
    placed = _split_on(placed, nodes, spill, threshold, leaf_rows, seed)
    leaves = placed.groupBy("id").agg(F.collect_list("leaf").alias("leaves"))
    counts = placed.groupBy("kind", "leaf").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / leaf_rows).cast("int")
    held = placed.join(counts.withColumn("chunks", chunks).drop("n"), ["kind", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int"))
    own = held.join(leaves, "id").join(nodes.select("id", "weight", "v"), "id")
    met = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("ci", F.least("chunk", "with")).withColumn("cj", F.greatest("chunk", "with"))
    found = met.select("kind", "leaf", "ci", "cj", "chunk", "id", "weight", "v", "leaves").groupBy("kind", "leaf", "ci", "cj").applyInArrow(_compare(threshold), "id long, links long, root long")
    found = written(found, "op4-found")
    dropped(placed)
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "op4-cc")
    per_class = nodes.select("id", "kind", "h1", "h2", "weight").join(linked, "id", "left").join(parts, "id", "left")
    per_class = written(per_class.select("kind", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "op4-classes")
    out = rows.select("id", "kind", "h1", "h2").join(per_class, ["kind", "h1", "h2"], "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("id").isNull() | (comp == F.col("id"))).alias("kept"))
