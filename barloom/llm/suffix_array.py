"""Suffix arrays by induced sorting, and permuted common prefixes.

Induced sorting (Nong, Zhang and Chan, 2009): suffixes are larger or smaller
than their successor; the leftmost of each run of smaller ones are sorted by
their substrings, recursively where substrings repeat, and all others are
induced from them in two scans. Over a small alphabet a scan goes by whole
buckets in numpy; the recursion's alphabets are large, and it goes one by one.
"""

from __future__ import annotations

import numpy as np

BY_BUCKET = 1024  # alphabets up to this size are scanned by bucket


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order; symbols are below k, the last is 0 and the only 0."""
    n = len(s)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    smaller = _smaller_than_next(s)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induced_by_bucket if k <= BY_BUCKET else _induced_one_by_one
    sizes = np.bincount(s, minlength=k)
    sa = induce(s, smaller, leftmost, sizes)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ordered = sa[is_leftmost[sa]]
    names = _named(s, smaller, ordered, leftmost)
    if names.max() + 1 < len(leftmost):
        ordered = leftmost[suffix_array(names, int(names.max()) + 1)]
    return induce(s, smaller, ordered, sizes)


def _smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor: decided where the next symbol differs; true for the last."""
    n = len(s)
    at = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.concatenate([s[at] < s[at + 1], [True]])


def _named(s: np.ndarray, smaller: np.ndarray, ordered: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, equal ones alike, in the order of the text."""
    ends = np.concatenate([leftmost[1:], leftmost[-1:]])
    length = np.zeros(len(s), np.int64)
    length[leftmost] = ends - leftmost + 1
    a, b = ordered[:-1], ordered[1:]
    equal = length[a] == length[b]
    offset = 0
    open_ = np.flatnonzero(equal)
    while len(open_):
        same = s[a[open_] + offset] == s[b[open_] + offset]
        equal[open_[~same]] = False
        offset += 1
        open_ = open_[same & (length[a[open_]] > offset)]
    rank = np.zeros(len(s), np.int64)
    rank[ordered] = np.concatenate([[0], np.cumsum(~equal)])
    return rank[leftmost]


def _induced_by_bucket(s: np.ndarray, smaller: np.ndarray, ordered: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    k, n = len(sizes), len(s)
    s = s.astype(np.uint16)  # short symbols sort by radix
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n_smaller = np.bincount(s[smaller], minlength=k)
    sa = np.full(n, -1, np.int64)
    # seeds at the ends of their buckets, in order
    symbols = s[ordered]
    by_symbol = np.argsort(symbols, kind="stable")
    n_seeds = np.bincount(symbols, minlength=k)
    first = np.cumsum(n_seeds) - n_seeds
    seeds = symbols[by_symbol]
    sa[(ends - n_seeds)[seeds] + np.arange(len(seeds)) - first[seeds]] = ordered[by_symbol]

    heads = starts.copy()

    def larger_before(block: np.ndarray) -> None:
        j = block - 1
        j = j[j >= 0]
        j = j[~smaller[j]]
        if not len(j):
            return
        order = np.argsort(s[j], kind="stable")
        j = j[order]
        c = s[j]
        counts = np.bincount(c, minlength=k)
        sa[heads[c] + np.arange(len(j)) - (np.cumsum(counts) - counts)[c]] = j
        heads[:] += counts

    for c in np.flatnonzero(sizes):
        at = starts[c]
        while at < heads[c]:
            block, at = sa[at : heads[c]], heads[c]
            larger_before(block)
        if n_seeds[c]:
            larger_before(sa[ends[c] - n_seeds[c] : ends[c]])

    tails = ends.copy()
    tails[0] = 0  # the last suffix is in place

    def smaller_before(block: np.ndarray) -> None:
        j = block - 1
        j = j[j >= 0]
        j = j[smaller[j]]
        if not len(j):
            return
        order = np.argsort(s[j], kind="stable")
        j = j[order]
        c = s[j]
        counts = np.bincount(c, minlength=k)
        sa[tails[c] - 1 - (np.arange(len(j)) - (np.cumsum(counts) - counts)[c])] = j
        tails[:] -= counts

    for c in np.flatnonzero(sizes)[::-1]:
        at = ends[c]
        while at > tails[c]:
            block, at = sa[tails[c] : at][::-1], tails[c]
            smaller_before(block)
        larger = sizes[c] - n_smaller[c]
        if larger:
            smaller_before(sa[starts[c] : starts[c] + larger][::-1])
    return sa


def _induced_one_by_one(s: np.ndarray, smaller: np.ndarray, ordered: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    text, is_smaller = s.tolist(), smaller.tolist()
    ends = np.cumsum(sizes)
    heads, tails = (ends - sizes).tolist(), ends.tolist()
    sa = [-1] * len(text)
    for j in reversed(ordered.tolist()):
        c = text[j]
        tails[c] -= 1
        sa[tails[c]] = j
    for i in range(len(sa)):
        j = sa[i] - 1
        if j >= 0 and not is_smaller[j]:
            c = text[j]
            sa[heads[c]] = j
            heads[c] += 1
    tails = ends.tolist()
    for i in range(len(sa) - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and is_smaller[j]:
            c = text[j]
            tails[c] -= 1
            sa[tails[c]] = j
    return np.array(sa, np.int64)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For each suffix the symbols it shares with the one before it in order, in text order, counted up to ``most``.

    A suffix whose predecessor's left neighbour equals its own shares one less
    than the suffix before it; only the others, and the given ``starts``, are
    compared. Right up to most - d at a distance d from a start. ``s`` are bytes.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    compared = np.ones(n, bool)
    inner = np.flatnonzero((before[1:] > 0)) + 1
    compared[inner] = s[inner - 1] != s[before[inner] - 1]
    compared[starts] = True
    words = np.ndarray((n + most,), "<u8", np.concatenate([s, np.zeros(most + 8, np.uint8)]).tobytes(), strides=(1,))
    at = np.flatnonzero(compared & (before >= 0))
    shared = np.zeros(n, np.int64)
    length = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        i, j = at[open_], before[at[open_]]
        differ = words[i + length[open_]] ^ words[np.minimum(j + length[open_], n)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        length[open_] += same
        open_ = open_[(same == 8) & (length[open_] < most)]
    shared[at] = np.minimum(length, most)
    last = np.maximum.accumulate(np.where(compared, np.arange(n), 0))
    return np.maximum(shared[last] - (np.arange(n) - last), 0)
