"""Nearest bit sets of a block of rows: groups of alike rows are passed over by a bound of their similarity, so few pairs are scored."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LEAF = 32


def _bits(words: np.ndarray, size: int) -> np.ndarray:
    """(n, size) of 0 and 1."""
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, :size]


def _keys(words: np.ndarray, size: int, drawn: Sequence[Sequence[int]]) -> np.ndarray:
    """(n, tables, words of a key): the bits at the positions of each draw."""
    width = -(-max(map(len, drawn)) // 64) * 8
    out = np.zeros((len(words), len(drawn), width), np.uint8)
    for at in range(0, len(words), 8192):
        bits = _bits(words[at : at + 8192], size)
        for t, p in enumerate(drawn):
            k = np.packbits(bits[:, list(p)], axis=1)
            out[at : at + 8192, t, : k.shape[1]] = k
    return out.view(np.uint64)


def _order(words: np.ndarray, size: int, sample: int = 256) -> np.ndarray:
    """The rows in an order in which alike ones are near: parted again and again by the bit that about half of them have."""
    out, stack = [], [np.arange(len(words))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        some = _bits(words[rows[:: -(-len(rows) // sample)]], size)
        bit = int(np.abs(some.mean(axis=0) - 0.5).argmin())
        has = (words[rows, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        if has.all() or not has.any():
            out.append(rows)
            continue
        stack += [rows[has], rows[~has]]
    return np.concatenate(out) if out else np.arange(0)


def parted(words: np.ndarray, size: int, parts: int) -> list | None:
    """A tree (bit, with it, without it) that deals alike rows to ``parts`` leaves; None is a leaf."""
    if parts < 2 or len(words) < 2:
        return None
    bit = int(np.abs(_bits(words, size).mean(axis=0) - 0.5).argmin())
    has = (words[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
    if has.all() or not has.any():
        return None
    one = min(max(round(parts * float(has.mean())), 1), parts - 1)
    return [bit, parted(words[has], size, one), parted(words[~has], size, parts - one)]


def nearest(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, w: np.ndarray, size: int, k: int, drawn: Sequence[Sequence[int]] | None = None, others: bool = False, least: np.ndarray | None = None, batch: int = 128) -> tuple[np.ndarray, ...]:
    """(query ids, ids, shared bits, similarity): the ``k`` rows of the largest Jaccard similarity of each query, exact; of ties the smaller ids.

    asked, ids: the ids of queries and rows; q, w: their packed words, (n, words) of uint64. drawn: only rows that have all bits of one of these draws
    in common with the query count; else those that share a bit. others: a row with the query's own id does not count.
    least: similarities below which rows of a query need not be found.
    A group's bound takes the bits that any of its rows has, and its smallest set.
    """
    empty = np.zeros(0, np.int64)
    if not len(asked) or not len(ids):
        return empty, empty, empty, np.zeros(0)
    order = _order(w, size)
    ids, w = ids[order], w[order]
    counts = lambda x: np.bitwise_count(x).sum(axis=-1, dtype=np.int64)
    n, nq = counts(w), counts(q)
    cuts = np.arange(0, len(ids), LEAF)
    most = _bits(np.bitwise_or.reduceat(w, cuts, axis=0), size).astype(np.float32).T.copy()
    low = np.minimum.reduceat(n, cuts)
    codes, qcodes = (_keys(w, size, drawn), _keys(q, size, drawn)) if drawn is not None else (None, None)
    inner = np.arange(LEAF)

    def scored(i: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, ...]:
        """(places of queries, of rows, shared, similarity) of all rows of groups that count."""
        r = (leaf[:, None] * LEAF + inner).ravel()
        i = np.repeat(i, LEAF)
        i, r = i[r < len(ids)], r[r < len(ids)]
        both = counts(w[r] & q[i])
        either = n[r] + nq[i] - both
        s = both / np.maximum(either, 1)
        ok = (s >= kth[i]) if drawn is not None else (s >= kth[i]) & (both > 0)
        if others:
            ok &= ids[r] != asked[i]
        i, r, both, s = i[ok], r[ok], both[ok], s[ok]
        if drawn is not None:
            ok = (codes[r] == qcodes[i]).all(axis=2).any(axis=1)
            i, r, both, s = i[ok], r[ok], both[ok], s[ok]
        return i, r, both, s

    def best(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        i, r, both, s = map(np.concatenate, zip(*parts))
        at = np.lexsort((ids[r], -s, i))
        i, r, both, s = i[at], r[at], both[at], s[at]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        full = place == k - 1
        kth[i[full]] = s[full]
        return tuple(x[place < k] for x in (i, r, both, s))

    kth, found = np.full(len(asked), -1.0) if least is None else least.copy(), []
    for start in range(0, len(asked), batch):
        at = np.arange(start, min(start + batch, len(asked)))
        shared = np.minimum((_bits(q[at], size).astype(np.float32) @ most).astype(np.int64), nq[at, None])
        bound = shared / np.maximum(nq[at, None] + np.maximum(low, shared) - shared, 1)
        own: tuple[np.ndarray, ...] = (empty, empty, empty, np.zeros(0))
        # the likeliest groups first, as what they hold rules out others
        for m in (4, 16, len(cuts)):
            if m < len(cuts):
                top = np.argpartition(-bound, m, axis=1)[:, :m]
                i, leaf = np.repeat(np.arange(len(at)), m), top.ravel()
                ok = bound[i, leaf] >= np.maximum(kth[at][i], 0)
                i, leaf = i[ok], leaf[ok]
            else:
                i, leaf = np.nonzero(bound >= np.maximum(kth[at], 0)[:, None])
            for c in range(0, len(i), 4096):
                own = best([own, scored(at[i[c : c + 4096]], leaf[c : c + 4096])])
            bound[i, leaf] = -1
        found.append(own)
    i, r, both, s = map(np.concatenate, zip(*found))
    return asked[i], ids[r], both, s
