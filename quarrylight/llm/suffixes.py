"""Difference-cover suffix sorting in whole-array operations, to a bounded depth.

Positions i with i mod 3 in {1, 2} are the sample. Their triples are sorted and named; if names repeat and do not yet reach the
depth, the names in turn are sorted by the same routine. The remaining suffixes follow from one symbol and the rank of the next
sampled suffix, and are merged with the sample by the keys that the difference cover makes comparable.
"""

from __future__ import annotations

import numpy as np


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of the pairs (a, b)."""
    key = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def suffix_order(s: np.ndarray, depth: int, reach: int = 1) -> np.ndarray:
    """Positions of s (symbols from 1) sorted by suffix; suffixes that agree in `depth` symbols of the first level stand together
    in any order. reach: first-level symbols that one symbol stands for."""
    n = len(s)
    if n < 4 or reach >= depth:
        if n < 4 and reach < depth:
            return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
        return np.argsort(s, kind="quicksort")
    t = np.concatenate([s, np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a padded position keeps the two sequences apart
    at = np.concatenate([one, two])
    name = _names(_names(t[at], t[at + 1]), t[at + 2])
    if 3 * reach >= depth or name.max() == len(name):
        rank = np.empty(len(at), np.int64)
        rank[np.argsort(name, kind="quicksort")] = np.arange(1, len(at) + 1)
    else:
        rank = np.empty(len(at), np.int64)
        rank[suffix_order(name, depth, 3 * reach)] = np.arange(1, len(at) + 1)
    ranks = np.zeros(n + 3, np.int64)
    ranks[at] = rank
    wide = len(at) + 2
    zero = np.arange(0, n, 3)
    key0 = t[zero] * wide + ranks[zero + 1]
    zero = zero[np.argsort(key0, kind="quicksort")]
    order = at[np.argsort(rank)]
    order = order[order < n]
    k1, k2 = order[order % 3 == 1], order[order % 3 == 2]
    pair = _pairs(t)
    of = lambda p: t[p] * wide + ranks[p + 1]
    of2 = lambda p: pair[p] * wide + ranks[p + 2]
    place = np.empty(n, np.float64)
    before = np.searchsorted(of(k1), of(zero)) + np.searchsorted(of2(k2), of2(zero))
    place[zero] = np.arange(len(zero)) + before
    # a sampled suffix stands behind the others of the sample before it and the rest that are less
    less = np.cumsum(np.bincount(before, minlength=len(order) + 1))[: len(order)]
    place[order] = np.arange(len(order)) + less
    return np.argsort(place, kind="quicksort")


def _pairs(t: np.ndarray) -> np.ndarray:
    key = np.append(t[:-1] * (int(t.max(initial=0)) + 1) + t[1:], 0)
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


WORD = 8


def window_classes(pieces: list[bytes], anchor: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal windows around anchors. Piece k has its anchor at byte anchor[k]; its windows start at bytes first[k] to
    last[k], all of them hold the anchor. Returns (piece, start, class) of all windows.

    Pieces are laid out so that anchors fall on word bounds. The suffixes of the word string are sorted by the difference-cover
    algorithm and neighbours compared; a window is then its whole words' class and the bytes that stick out on both sides,
    which are one word together."""
    whole = length // WORD - 1
    size = np.array([len(p) for p in pieces])
    pad = -anchor % WORD
    room = pad + size + (-(pad + size)) % WORD
    base = np.cumsum(room) - room
    buffer = np.zeros(int(room.sum()) + WORD, np.uint8)
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    buffer[np.arange(len(joined)) + np.repeat(base + pad - (np.cumsum(size) - size), size)] = joined
    words = buffer[:-WORD].view("<u8")
    order = suffix_order(np.unique(words, return_inverse=True)[1].astype(np.int64) + 1, whole)
    order = order[order <= len(words) - whole]
    new = np.ones(len(order), bool)
    views = np.lib.stride_tricks.sliding_window_view(words, whole)
    step = 50_000
    for lo in range(1, len(order), step):
        hi = min(len(order), lo + step)
        new[lo:hi] = (views[order[lo:hi]] != views[order[lo - 1 : hi - 1]]).any(axis=1)
    run = np.zeros(len(words), np.int64)
    run[order] = np.cumsum(new)
    n = last - first + 1
    piece = np.repeat(np.arange(len(pieces)), n)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    at = base[piece] + pad[piece] + start
    head = -at % WORD  # bytes before the first whole word
    block = (at + head) // WORD
    tail = block * WORD + whole * WORD
    lead = _word_at(buffer, at) & _low(head)
    rest = _word_at(buffer, tail) & _low(WORD - head)
    extra = lead | np.where(head > 0, rest << (np.uint64(8) * head.astype(np.uint64)), rest)
    key = run[block] * WORD + head
    order = np.lexsort((extra, key))
    k, e = key[order], extra[order]
    new = np.append(True, (k[1:] != k[:-1]) | (e[1:] != e[:-1]))[: len(k)]
    cls = np.empty(len(key), np.int64)
    cls[order] = np.cumsum(new) - 1
    return piece, start, cls


def _low(n: np.ndarray) -> np.ndarray:
    """Mask of the n first bytes of a word."""
    return np.where(n >= WORD, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * (n % WORD).astype(np.uint64))) - np.uint64(1))


def _word_at(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The word of eight bytes at any place; bytes beyond the buffer are zeros."""
    padded = np.concatenate([buffer, np.zeros(WORD, np.uint8)])
    words = padded[: len(padded) // WORD * WORD].view("<u8")
    low, shift = at // WORD, (at % WORD).astype(np.uint64) * np.uint64(8)
    return np.where(shift > 0, (words[low] >> shift) | (words[np.minimum(low + 1, len(words) - 1)] << (np.uint64(64) - np.maximum(shift, np.uint64(1)))), words[low])
