"""Prediction by partial matching over bytes.

A symbol is a byte, or END after the last one; contexts of the first bytes are filled with START. The trie of
contexts is kept as one sorted table a level: level k holds (context of k symbols, symbol) packed into an integer,
nine bits a symbol, with its count. The suffix of a packed gram is its low bits, so shorter contexts are masks.

A symbol is coded in the longest context seen. There a symbol seen n times of C, with d distinct ones, has
probability n / (C + d), and the escape d / (C + d) (method C). After an escape the symbols of the longer context
are excluded: they have no share in the counts of the shorter one. A symbol that no context knows is coded evenly
among those left. All counts are frozen, so a gram's code length is a function of the gram, computed once for each
distinct gram.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

BITS = 9
END, START = 256, 257
SYMBOLS = 257


def mask(k: int) -> int:
    """Of the low k symbols."""
    return (1 << BITS * k) - 1


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All grams of order + 1 symbols, text after text, and where each text's grams start. No text is without one."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    seq = np.full(total + order * len(texts), START, np.int64)
    # each text stands after its own START symbols
    at = starts + order * np.arange(1, len(texts) + 1)
    body = np.ones(len(seq), bool)
    for j in range(order):
        body[at - 1 - j] = False
    body[at + sizes - 1] = False
    seq[body] = np.frombuffer(b"".join(texts), np.uint8)
    seq[at + sizes - 1] = END
    out = np.zeros(len(seq), np.int64)
    for j in range(order, -1, -1):
        out <<= BITS
        out[order:] |= seq[order - j : len(seq) - j]
    keep = np.ones(len(seq), bool)
    for j in range(order):
        keep[at - 1 - j] = False
    return out[keep], starts


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distinct values, by hashing."""
    return pd.factorize(values)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Level:
    """(context, symbol) of one length: counts, and of each context C, d and what its symbols count one level below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, symbols: int, below: Level | None):
        self.keys, self.counts = keys, counts
        self.contexts, first = np.unique(keys >> BITS, return_index=True)
        self.total = np.add.reduceat(counts, first) if len(keys) else counts[:0]
        self.kinds = np.diff(np.append(first, len(keys)))
        self.shared = None
        if below is not None and len(keys):
            at, there = find(below.keys, keys & mask(symbols - 1))
            self.shared = np.add.reduceat(np.where(there, below.counts[at], 0), first)


def levels(keys: np.ndarray, counts: np.ndarray, order: int) -> list[Level]:
    """Tables of all levels, from the counts of the longest grams; level k has contexts of k symbols."""
    out: list[Level] = []
    for k in range(order + 1):
        low = keys & mask(k + 1)
        u, code = np.unique(low, return_inverse=True)
        out.append(Level(u, np.bincount(code, counts, len(u)).astype(np.int64), k + 1, out[-1] if out else None))
    return out


def bits(table: list[Level], keys: np.ndarray) -> np.ndarray:
    """Code length in bits of each gram's last symbol after the symbols before it."""
    cost = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    kinds = np.zeros(len(keys), np.int64)  # of the longer context that was escaped from
    shared = np.zeros(len(keys), np.int64)
    for k in range(len(table) - 1, -1, -1):
        level = table[k]
        low = keys & mask(k + 1)
        node, there = find(level.contexts, low >> BITS)
        there &= open_
        if not there.any():
            continue
        i = np.flatnonzero(there)
        c, d = level.total[node[i]] - shared[i], level.kinds[node[i]] - kinds[i]
        at, known = find(level.keys, low[i])
        n = np.where(known, level.counts[at], 0)
        hit = n > 0
        cost[i[hit]] += np.log2((c + d)[hit] / n[hit])
        # nothing new in this context: the escape is certain
        miss = ~hit & (d > 0)
        cost[i[miss]] += np.log2((c + d)[miss] / d[miss])
        open_[i[hit]] = False
        kinds[i] = level.kinds[node[i]]
        shared[i] = level.shared[node[i]] if level.shared is not None else 0
    left = SYMBOLS - kinds[open_]
    cost[open_] += np.log2(np.maximum(left, 1))
    return cost
