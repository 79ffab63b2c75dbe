"""Suffix arrays by induced sorting, with whole stretches of the scan taken at once.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour.
The substrings between leftmost S places are sorted by induction, named, and the
string of names is sorted recursively; one more induction sorts all suffixes.
A scan handles the longest stretch that its own insertions cannot reach, so the
result is that of the scan place by place.
"""

from __future__ import annotations

import numpy as np

#: Places in a text; texts are shards of far less than 2^31 symbols.
_PLACE = np.int32


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by value, rank within the value, the different values and their counts.

    Scans call this for very short stretches, so it keeps from numpy's slower wrappers.
    """
    order = np.argsort(values, kind="stable")
    row = values[order]
    n = len(row)
    cut = (row[1:] != row[:-1]).nonzero()[0]
    first = np.zeros(len(cut) + min(1, n), np.int64)
    first[1:] = cut + 1
    count = np.empty_like(first)
    count[:-1] = first[1:] - first[:-1]
    count[-1:] = n - first[-1:]
    rank = np.arange(n) - first.repeat(count)
    return order, rank, row[first], count


def _scan(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, at: np.ndarray, step: int) -> None:
    """Insert before-neighbours in scan order; `wanted[p]` says whether suffix p belongs to this scan.

    `at[c]` is the next free place of bucket c; `step` is 1 from left to right
    and -1 from right to left.
    """
    n = len(sa)
    view = sa if step == 1 else sa[::-1]  # the scan always walks up in `view`
    place = at if step == 1 else n - 1 - at
    i, size = 0, 1024
    while i < n:
        j = min(i + size, n)
        entry = view[i:j]
        where = (entry > 0).nonzero()[0]
        before = entry[where] - 1
        keep = wanted[before]
        where, before = where[keep] + i, before[keep]
        if not len(where):
            i, size = j, min(size * 2, 1 << 17)
            continue
        c = s[before]
        limit = np.minimum.accumulate(place[c])
        late = (where[1:] >= limit[:-1]).nonzero()[0]
        if len(late):
            m = int(late[0]) + 1
            where, before, c, limit = where[:m], before[:m], c[:m], limit[:m]
        order, rank, value, count = _groups(c)
        view[place[c[order]] + rank] = before[order]
        place[value] += count.astype(_PLACE)
        done = min(j, int(limit[-1]))
        size = min(size * 2, 1 << 17) if done == j else max(64, 2 * (done - i))
        i = done


def _induce(s: np.ndarray, small: np.ndarray, starts: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffixes in the order that the given order of the leftmost S places induces."""
    n = len(s)
    sa = np.full(n, -1, _PLACE)
    order, rank, value, count = _groups(s[lms])
    last = np.repeat(count, count) - 1 - rank
    spots = ends[s[lms][order]] - last
    sa[spots] = lms[order]
    larger = ~small
    heads = starts.copy()
    sa[heads[s[n - 1]]] = n - 1  # induced by the end of the text
    heads[s[n - 1]] += 1
    _scan(sa, s, larger, heads, 1)
    sa[spots] = -1
    _scan(sa, s, small, ends.copy(), -1)
    return sa


def suffix_array(s: np.ndarray, size: int | None = None) -> np.ndarray:
    """Places of the suffixes of `s` (whole numbers from 0 below `size`) in ascending order."""
    n = len(s)
    if n == 0:
        return np.zeros(0, _PLACE)
    size = int(s.max()) + 1 if size is None else size
    if n == 1:
        return np.zeros(1, _PLACE)
    # S where the next different value to the right is larger; the end of the text is the smallest.
    differ = np.flatnonzero(s[1:] != s[:-1])
    upto = np.searchsorted(differ, np.arange(n))
    known = upto < len(differ)
    edge = differ[np.minimum(upto, max(len(differ) - 1, 0))] if len(differ) else np.zeros(n, np.int64)
    small = np.zeros(n, bool)
    small[known] = s[edge[known]] < s[edge[known] + 1]
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(_PLACE)
    count = np.bincount(s, minlength=size)
    ends = (np.cumsum(count) - 1).astype(_PLACE)
    starts = (ends - count + 1).astype(_PLACE)
    if len(lms) == 0:
        return _induce(s, small, starts, ends, lms)
    sa = _induce(s, small, starts, ends, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    row = sa[is_lms[sa]]
    names = _names(s, small, is_lms, lms, row)
    if names[-1] == len(row) - 1:
        return _induce(s, small, starts, ends, row)
    name_at = np.zeros(n, _PLACE)
    name_at[row] = names
    reduced = name_at[lms]
    return _induce(s, small, starts, ends, lms[suffix_array(reduced, int(names[-1]) + 1)])


def _names(s: np.ndarray, small: np.ndarray, is_lms: np.ndarray, lms: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of the substring that begins at each of the sorted leftmost S places; equal ones share it."""
    n = len(s)
    length = np.zeros(n, _PLACE)
    length[lms] = np.diff(np.append(lms, n)) + 1
    a, b = row[:-1], row[1:]
    new = length[a] != length[b]
    whole = (a + length[a] > n) | (b + length[b] > n)  # the last one is like no other
    new |= whole
    open_ = np.flatnonzero(~new)
    k = 0
    while len(open_):
        x, y = a[open_] + k, b[open_] + k
        bad = (s[x] != s[y]) | (small[x] != small[y])
        new[open_[bad]] = True
        open_ = open_[~bad]
        k += 1
        open_ = open_[k < length[a[open_]]]
    return np.concatenate([[0], np.cumsum(new)])


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length that each suffix shares with its neighbour before it in the suffix array, by place in the text.

    Where the neighbour is also one place on, the length is one less; only the
    other places are compared.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, _PLACE)
    before[sa[1:]] = sa[:-1]
    head = np.ones(n, bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (s[:-1] != s[np.maximum(before[:-1], 0)])
    place = np.flatnonzero(head)
    lengths = np.zeros(len(place), np.int64)
    open_ = np.flatnonzero(before[place] >= 0)
    k = 0
    while len(open_):
        x, y = place[open_] + k, before[place[open_]] + k
        inside = (x < n) & (y < n)
        same = inside.copy()
        same[inside] = s[x[inside]] == s[y[inside]]
        lengths[open_[~same]] = k
        open_ = open_[same]
        k += 1
    which = np.cumsum(head) - 1
    return np.maximum(lengths[which] - (np.arange(n) - place[which]), 0)
