"""Suffix arrays by induced sorting, and the permuted common prefixes that repeated windows are read from.

Suffixes are classified as smaller or larger than the next one; the leftmost-smaller (LMS) substrings are sorted by
inducing, named, and sorted recursively where names repeat; the whole array is then induced from them in linear time.
Over small alphabets a bucket is induced in a few array operations at a time, over large ones entry by entry.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
SMALL = 512


def classify(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller, positions): whether each suffix is smaller than the next, and the LMS positions. ``s`` ends in a unique least symbol."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    if n > 1:
        nearest = differs[np.searchsorted(differs, np.arange(n - 1))]  # the last suffix differs from all, so one is found
        smaller[:-1] = s[nearest] < s[nearest + 1]
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _induce_buckets(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    n = len(s)
    count = np.bincount(s, minlength=sigma)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, np.int64)
    at_lms = np.bincount(s[lms], minlength=sigma)
    order = np.argsort(s[lms], kind="stable")
    first = np.cumsum(at_lms) - at_lms
    c = s[lms][order]
    sa[end[c] - at_lms[c] + np.arange(len(lms)) - first[c]] = lms[order]

    def push(found: np.ndarray, kind: bool, pointer: np.ndarray, step: int) -> None:
        found = found[found > 0] - 1
        found = found[smaller[found] == kind]
        if len(found):
            c = s[found]
            order = np.argsort(c, kind="stable")
            c, found = c[order], found[order]
            n_c = np.bincount(c, minlength=sigma)
            rank = np.arange(len(c)) - (np.cumsum(n_c) - n_c)[c]
            sa[pointer[c] + step * rank] = found
            pointer += step * n_c

    used = np.flatnonzero(count)
    head = start.copy()
    for c in used:
        low = start[c]
        while low < head[c]:
            high = head[c]
            push(sa[low:high], False, head, 1)
            low = high
        push(sa[end[c] - at_lms[c] : end[c]], False, head, 1)
    tail = end - 1
    for c in used[::-1]:
        high = end[c] - 1
        while high > tail[c]:
            low = tail[c]
            push(sa[low + 1 : high + 1][::-1], True, tail, -1)
            high = low
        push(sa[start[c] : head[c]][::-1], True, tail, -1)
    sa[0] = n - 1  # the last suffix follows from no other
    return sa


def _induce_entries(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    n = len(s)
    count = np.bincount(s, minlength=sigma)
    ends = np.cumsum(count)
    before = [0, *s[:-1].tolist()]  # the symbol before each suffix, and whether that makes a larger or a smaller one
    up = [False, *smaller[:-1].tolist()]
    down = [False, *(~smaller[:-1]).tolist()]
    sa = [0] * n  # 0 stands for an empty place: nothing is before the first suffix
    tail = (ends - 1).tolist()
    for i, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist(), strict=True):
        sa[tail[c]] = i
        tail[c] -= 1
    head = (ends - count).tolist()
    for i in sa:  # the list grows into the places that are read later
        if down[i]:
            c = before[i]
            h = head[c]
            sa[h] = i - 1
            head[c] = h + 1
    tail = (ends - 1).tolist()
    for i in reversed(sa):
        if up[i]:
            c = before[i]
            h = tail[c]
            sa[h] = i - 1
            tail[c] = h - 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``s``, whose symbols are under ``sigma`` and whose last is a unique 0."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    smaller, lms = classify(s)
    induce = _induce_buckets if sigma <= SMALL else _induce_entries
    if len(lms) == 0:
        return induce(s, smaller, lms, sigma)
    sa = induce(s, smaller, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    follows = np.full(n, n - 1, np.int64)
    follows[lms[:-1]] = lms[1:]
    a, b = ordered[:-1], ordered[1:]
    length = follows[ordered] - ordered + 1
    same = length[:-1] == length[1:]
    live, k = np.flatnonzero(same), 0
    while len(live):  # equal LMS substrings get one name
        live = live[k < length[live]]
        bad = s[a[live] + k] != s[b[live] + k]
        same[live[bad]] = False
        live, k = live[~bad], k + 1
    names = np.zeros(n, np.int64)
    names[ordered] = np.r_[0, np.cumsum(~same)]
    reduced = names[lms]
    different = int(reduced.max()) + 1
    inner = suffix_array(reduced, different) if different < len(lms) else np.argsort(reduced)
    return induce(s, smaller, lms[inner], sigma)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, common) in text order: the suffix sorted before each one, and their common prefix in whole words of 8 bytes up to ``most``."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.r_[text, np.arange(8 + most) % 7 + 300].astype(np.uint16)  # no match reaches past the end
    half = padded[:-1].astype(np.uint64) << np.uint64(16) | padded[1:]
    words = half[:-2] << np.uint64(32) | half[2:]
    common = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for k in range(0, most, 4):
        live = live[np.maximum(live, before[live]) + k + 4 <= n]
        live = live[words[live + k] == words[before[live] + k]]
        common[live] = k + 4
    return before, common


def repeated_starts(text: np.ndarray, sa: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` bytes from each position also start at another one."""
    before, common = permuted_prefixes(text, sa, width)
    out = common >= width
    out[before[out]] = True
    return out
