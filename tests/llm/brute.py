"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import numpy as np


def shingles(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < words else frozenset(zip(*(w[i:] for i in range(words)), strict=False))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def near_duplicates(rows, words, similarity=80):
    """id: (number of shingles, component)."""
    sets = {i: shingles(t, words) for i, t in rows}

    def linked(a, b):
        inter = len(sets[a] & sets[b])
        return inter > 0 and 100 * inter >= similarity * len(sets[a] | sets[b])

    comp = components(sorted(sets), linked)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def embedding_links(rows, threshold=0.98):
    """rows: (id, vector, label); id: (links, component)."""
    fine = {i: np.asarray(v, float) for i, v, l in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: l for i, _, l in rows}

    def linked(a, b):
        if a not in fine or b not in fine or label[a] != label[b] or len(fine[a]) != len(fine[b]):
            return False
        return fine[a] @ fine[b] / (np.linalg.norm(fine[a]) * np.linalg.norm(fine[b])) >= threshold

    ids = sorted(i for i, _, _ in rows)
    comp = components(ids, linked)
    return {i: (sum(linked(i, j) for j in ids if j != i), comp[i]) for i in ids}


def viterbi(text, scores, fallback):
    """The best sum of scores over all segmentations, and the pieces of the best one (ties: the longer last piece)."""
    n = len(text)
    best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        for length in range(end, 0, -1):
            piece = text[end - length : end]
            s = scores.get(piece, fallback if length == 1 else None)
            if s is not None and best[end - length] + s > best[end]:
                best[end], back[end] = best[end - length] + s, piece
    out = []
    while n:
        out.append(back[n])
        n -= len(back[n])
    return best[-1], out[::-1]


def pseudo_likelihood(hashes, words, flat):
    """The sum of log P(word | two words on each side), one word and one softmax at a time."""
    from cloakwork.llm import lm_scoring as L

    embed, w1, b1, w2, b2, w3, b3 = (np.asarray(x, float) for x in L.unpacked(flat))
    buckets = [int(h) % L.FINE for h in hashes]
    tokens = [int(words.token[b]) for b in buckets]
    total = 0.0
    for i, t in enumerate(tokens):
        sides = [tokens[j] + 1 if 0 <= j < len(tokens) else 0 for j in (i - 2, i - 1, i + 1, i + 2)]
        h = np.tanh(np.concatenate([embed[s] for s in sides]) @ w1 + b1)
        z, y = h @ w2 + b2, h @ w3[t % L.CLASSES] + b3[t % L.CLASSES]
        total += z[t % L.CLASSES] - np.log(np.exp(z).sum()) + y[t // L.CLASSES] - np.log(np.exp(y).sum()) + float(words.inside[buckets[i]])
    return total
