"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, scores documents.

The network reads the two words to the left and the two to the right of a masked word and predicts the word
itself: embeddings of the four tokens, one weight block per position, tanh, then a softmax in two
steps, the token's class and the token in its class; both steps have weights on the hidden layer, so the
probability of every token depends on both sides. The score of a document is the sum of
log P(word | both sides) over all its words.

*Tokens.* The ``VOCAB - SHARED`` words that are most frequent over all documents (by ``FINE`` hash buckets; ties: the smaller
bucket) are tokens of their own; all others share ``SHARED`` tokens by hash, and in a shared token a word also has the
probability of its bucket among that token's words. The counts cover every word of every document: each task adds up its
own, one aggregation adds those.

*Training* predicts every word of every document in each of ``rounds`` rounds; each task runs minibatches of ``BATCH`` words,
dealt from a pool of many documents, from the common weights (which start as the token frequencies). The tasks' weights are
averaged by the number of trained words, in blocks, a group of tasks at a time. Only the counts and the model (both of fixed size)
reach the driver.

Documents without words (null, empty) have n_tokens 0, log_likelihood 0 and a null mean. Rows that
repeat are scored alike. Texts are read in pieces, so memory holds for a piece of any text. Columns other than the id and the
text are not read, so their names can clash with nothing. Every number is reproducible: seeds are fixed and rows of a task are read in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, slices, utf8

CLASSES, WITHIN, FINE = 64, 128, 1 << 20
VOCAB, SHARED = CLASSES * WITHIN, 1024
DIM, HIDDEN, SIDE = 8, 16, 2
ROUNDS, BATCH, RATE = 1, 4096, 0.3
#: Words in a pool, of which minibatches are dealt, and in a piece of a text.
_POOL = 16 * BATCH
#: Floats in a block, and tasks whose weights one group averages.
_BLOCK, _FAN = 1 << 14, 64
SHAPES = ((VOCAB + 1, DIM), (2 * SIDE * DIM, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, WITHIN), (CLASSES, WITHIN))


class Vocabulary:
    """The token of each fine bucket, and log P(bucket | token), 0 for words that are tokens of their own. ``counts``: of the fine buckets."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")[: VOCAB - SHARED]
        self.token = (VOCAB - SHARED + np.arange(FINE) % SHARED).astype(np.int16)
        self.token[order] = np.arange(len(order))
        rest = counts + 0.5
        rest[order] = 0
        totals = np.bincount(self.token, rest, VOCAB)
        self.inside = np.zeros(FINE, np.float32)
        shared = rest > 0
        self.inside[shared] = np.log(rest[shared] / totals[self.token[shared]])
        self.counts = np.bincount(self.token, counts, VOCAB)


def fine(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FINE - 1)).astype(np.int64)


def fresh(counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Weights that predict tokens by their frequencies (``counts`` of VOCAB tokens); token t is number t // CLASSES of class t % CLASSES."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate([(rng.standard_normal(s) * (0.3 if len(s) > 1 else 0.0) / (1 if s[0] == VOCAB + 1 else HIDDEN)).ravel() for s in SHAPES]).astype(np.float32)
    p, table = unpacked(flat), counts.reshape(WITHIN, CLASSES).T
    p[4][:] = np.log((table.sum(axis=1) + 0.5) / (table.sum() + 0.5 * CLASSES))
    p[6][:] = np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * WITHIN))
    return flat


def unpacked(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in SHAPES:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def windows(tokens: np.ndarray) -> np.ndarray:
    """The 2 * SIDE tokens around each word of one text, from 1 on; 0 beyond its edges."""
    edge = np.zeros(SIDE, np.int16)
    padded = np.concatenate((edge, tokens.astype(np.int16) + np.int16(1), edge))
    n = len(tokens)
    return np.stack([padded[o : o + n] for o in range(2 * SIDE + 1) if o != SIDE], axis=1)


def examples(tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, token) of every word of a text, in pieces of bounded size."""
    for at in range(0, len(tokens), _POOL):
        lo, end = max(0, at - SIDE), min(len(tokens), at + _POOL)
        own = slice(at - lo, end - lo)
        yield windows(tokens[lo : end + SIDE])[own], tokens[at:end]


class Net:
    """The network over given weights; ``step`` trains it by Adagrad."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32).copy()
        self.p = unpacked(self.flat)
        self.seen = 0
        self.g2: list[np.ndarray] = []

    def _forward(self, context: np.ndarray, cls: np.ndarray) -> tuple:
        """Inputs, hidden layer, logits of classes and of tokens in the class, and the classes' spans. Rows are in order of their class."""
        p = self.p
        x = p[0].take(context.ravel(), axis=0).reshape(len(context), -1)
        h = np.tanh(x @ p[1] + p[2])
        z = h @ p[3]
        z += p[4]
        ends = np.searchsorted(cls, np.arange(CLASSES + 1))
        spans = [(c, slice(ends[c], ends[c + 1])) for c in np.flatnonzero(ends[1:] > ends[:-1])]
        y = p[6].take(cls, axis=0)
        for c, own in spans:
            y[own] += h[own] @ p[5][c]
        for logits in (z, y):
            logits -= logits.max(axis=1, keepdims=True)
        return x, h, z, y, spans

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log P(token | context) of each row."""
        out = np.empty(len(token))
        for at in range(0, len(token), BATCH):
            t = token[at : at + BATCH].astype(np.int64)
            order = np.argsort((t % CLASSES).astype(np.int16), kind="stable")
            t, rows = t[order], np.arange(len(t))
            _, _, z, y, _ = self._forward(context[at : at + BATCH][order], t % CLASSES)
            picked = z[rows, t % CLASSES].astype(np.float64) + y[rows, t // CLASSES]
            np.exp(z, out=z)
            np.exp(y, out=y)
            out[at + order] = picked - np.log(z.sum(axis=1)) - np.log(y.sum(axis=1))
        return out

    def step(self, context: np.ndarray, token: np.ndarray) -> None:
        if not self.g2:
            self.g2 = [np.full(a.shape, 1e-2, np.float32) for a in self.p]
        p, n = self.p, len(token)
        t = token.astype(np.int64)
        order = np.argsort((t % CLASSES).astype(np.int16), kind="stable")
        t, context = t[order], context[order]
        x, h, z, y, spans = self._forward(context, t % CLASSES)
        rows = np.arange(n)
        for logits, at in ((z, t % CLASSES), (y, t // CLASSES)):
            np.exp(logits, out=logits)
            logits *= 1 / (n * logits.sum(axis=1, keepdims=True))
            logits[rows, at] -= np.float32(1 / n)
        dh = z @ p[3].T
        inner, bias = np.zeros_like(p[5]), np.zeros_like(p[6])
        for c, own in spans:
            np.matmul(h[own].T, y[own], out=inner[c])
            bias[c] = y[own].sum(axis=0)
            dh[own] += y[own] @ p[5][c].T
        dh *= 1 - h * h
        dx = (dh @ p[1].T).reshape(n * 2 * SIDE, DIM)
        flat = context.ravel()
        order = np.argsort(flat, kind="stable")  # a radix sort: 16 bits
        words = flat[order]
        new = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        words, de = words[new], np.add.reduceat(dx.take(order, axis=0), new, axis=0)
        for i, g in ((1, x.T @ dh), (2, dh.sum(axis=0)), (3, h.T @ z), (4, z.sum(axis=0)), (5, inner), (6, bias)):
            self.g2[i] += g * g
            p[i] -= RATE * g / np.sqrt(self.g2[i])
        self.g2[0][words] += de * de
        p[0][words] -= RATE * de / np.sqrt(self.g2[0][words])
        self.seen += n

    def pool(self, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Steps over all of ``held``; each takes words from all over it, ``BATCH`` at most."""
        context, token = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        steps = -(-len(token) // BATCH)
        for i in range(steps):
            self.step(context[i::steps], token[i::steps])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often each fine bucket occurs in all of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = WordHasher(), np.zeros(FINE, np.int64)
        for batch in slices(batches, 1):
            found = list(hasher.texts(utf8(batch.column(1))))
            if found:
                np.add.at(total, fine(np.concatenate(found)), 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    found = docs.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(FINE)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def _averaged(table: pa.Table) -> pa.Table:
    """One row of a group of rows (task, block, n, w): the weights' mean by n."""
    n = table.column("n").to_numpy().astype(np.float64)
    total = 0.0
    for weight, w in zip(n, table.column("w"), strict=True):
        total = total + weight * np.frombuffer(w.as_buffer(), np.float32)
    mean = (total / n.sum()).astype(np.float32).tobytes()
    return pa.table({"task": table.column("task").slice(0, 1), "block": table.column("block").slice(0, 1), "n": pa.array([int(n.sum())], pa.int64()), "w": pa.array([mean], pa.binary())})


def train_round(docs: DataFrame, words: Vocabulary, flat: np.ndarray) -> np.ndarray:
    shared = docs.sparkSession.sparkContext.broadcast((words.token, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, held, size = WordHasher(), [], 0
        token, net = shared.value[0], Net(shared.value[1])
        for batch in slices(batches, 1):
            for h in hasher.texts(utf8(batch.column(1))):
                for one in examples(token[fine(h)]):
                    held.append(one)
                    size += len(one[1])
                    if size >= _POOL:
                        net.pool(held)
                        held, size = [], 0
        if held:
            net.pool(held)
        if net.seen:
            blocks = [net.flat[at : at + _BLOCK].tobytes() for at in range(0, len(net.flat), _BLOCK)]
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([net.seen] * k, pa.int64()), pa.array(blocks, pa.binary())], names=["task", "block", "n", "w"])

    schema = "task long, block int, n long, w binary"
    found, tasks = docs.mapInArrow(run, schema), docs.rdd.getNumPartitions()
    while True:
        found = found.withColumn("task", F.floor(F.col("task") / _FAN)).groupBy("task", "block").applyInArrow(_averaged, schema)
        tasks = -(-tasks // _FAN)
        if tasks <= 1:
            break
    rows = found.select("block", "w").collect()
    out = flat.copy()
    for r in rows:
        w = np.frombuffer(r["w"], np.float32)
        out[r["block"] * _BLOCK : r["block"] * _BLOCK + len(w)] = w
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the weights, from the whole corpus."""
    own = _texts(docs, id_col, text_col)
    words = Vocabulary(word_counts(own))
    flat = fresh(words.counts)
    for _ in range(rounds):
        flat = train_round(own, words, flat)
    return words, flat


def score(docs: DataFrame, model: tuple[Vocabulary, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, log_likelihood, mean_log_likelihood."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].token, model[0].inside, model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (token, inside, flat) = WordHasher(), shared.value
        net = Net(flat)
        for batch in slices(batches, 1, 1 << 20):
            n, total = [], np.zeros(batch.num_rows)
            held, rows, size = [], [], 0
            for i, h in enumerate(hasher.texts(utf8(batch.column(1)))):
                n.append(len(h))
                bucket = fine(h)
                total[i] += inside[bucket].sum(dtype=np.float64)
                for one in examples(token[bucket]):
                    held.append(one)
                    rows.append(i)
                    size += len(one[1])
                    if size >= _POOL:
                        _add(net, held, rows, total)
                        held, rows, size = [], [], 0
            _add(net, held, rows, total)
            mean = [t / k if k else None for t, k in zip(total.tolist(), n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64())], names=["id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    found = _texts(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
    return found.withColumnRenamed("id", id_col)


def _add(net: Net, held: list, rows: list[int], total: np.ndarray) -> None:
    """Adds the log-probabilities of the pieces ``held`` to the totals of their ``rows``."""
    if held:
        sums = net.log_probabilities(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        np.add.at(total, np.repeat(rows, [len(x[1]) for x in held]), sums)
