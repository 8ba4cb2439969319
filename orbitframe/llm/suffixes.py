"""Sorting suffixes by comparing prefix hashes.

Two suffixes are compared by finding their common extension with a binary search over polynomial prefix hashes,
so a comparison takes a logarithmic number of steps whatever the length of the common part.  The merge sort runs
bottom-up over many independent groups at once: each level ranks every suffix in its sibling run.

Collisions are told afterwards: the sorted neighbours' common prefixes are compared value by value, and the values
behind them by size.  Neighbours at the same distance share what they have in common, so each value is compared
once per distance.  If any differ, the suffixes are sorted again by exact ranks of their runs of 1, 2, 4 and so on
values, which need more memory but no hash.
"""

from __future__ import annotations

import numpy as np

from orbitframe.llm.kernels import gather, powers


class Ranks:
    """Numbers of the runs of 1, 2, 4 and so on values of a sequence, equal for equal runs alone."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.levels = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
        size = 1
        while 2 * size <= longest:
            low = self.levels[-1].astype(np.int64)
            pair = low[:-size] * (int(low.max()) + 1) + low[size:]
            self.levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
            size *= 2

    def common_prefix(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            open_ = np.flatnonzero(got + (1 << k) <= most)
            same = rank[a[open_] + got[open_]] == rank[b[open_] + got[open_]]
            got[open_[same]] += 1 << k
        return got


def common_prefix(prefix: np.ndarray | Ranks, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b, at most most."""
    if isinstance(prefix, Ranks):
        return prefix.common_prefix(a, b, most)
    got = np.zeros(len(a), np.int64)
    if not len(a) or not (top := int(most.max())):
        return got
    up = powers(len(prefix))[0]
    low, high = np.minimum(a, b), np.maximum(a, b)
    lift, base_low, base_high = up[high - low], prefix[low], prefix[high]
    step = 1 << (top.bit_length() - 1)
    while step:
        t = got + step
        fits = t <= most
        t = np.minimum(t, most)
        same = (prefix[low + t] - base_low) * lift == prefix[high + t] - base_high
        got = np.where(fits & same, t, got)
        step >>= 1
    return got


def less(prefix: np.ndarray | Ranks, codes: np.ndarray, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a sorts before b, their texts are equal); a text that ends sorts before its extensions."""
    room_a, room_b = end_a - a, end_b - b
    most = np.minimum(room_a, room_b)
    n = common_prefix(prefix, a, b, most)
    ended = n == most
    last = len(codes) - 1
    before = np.where(ended, room_a < room_b, codes[np.minimum(a + n, last)] < codes[np.minimum(b + n, last)])
    return before, ended & (room_a == room_b)


def sort_groups(prefix: np.ndarray | Ranks, codes: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order of the suffixes start:end within each group first[i]:first[i+1]; equal ones keep their order."""
    n = len(start)
    order = np.arange(n)
    if n == 0:
        return order
    sizes = np.diff(first)
    g_lo, g_hi = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
    width = 1
    while width < sizes.max():
        at = np.flatnonzero(g_hi - g_lo > width)
        r = at - g_lo[at]
        block = r // width
        left = block % 2 == 0
        lo = np.minimum(g_lo[at] + (block ^ 1) * width, g_hi[at])
        hi = np.minimum(lo + width, g_hi[at])
        sib, me = lo.copy(), order[at]
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            other, own = order[mid], me[open_]
            before, equal = less(prefix, codes, start[other], start[own], end[other], end[own])
            go = before | (equal & ~left[open_])  # of equals, those of the left run come first
            lo[open_[go]] = mid[go] + 1
            hi[open_[~go]] = mid[~go]
        pair = g_lo[at] + (block & ~1) * width
        order[pair + (r % width) + (lo - sib)] = me
        width *= 2
    return order


def neighbours_hold(codes: np.ndarray, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, common: np.ndarray) -> bool:
    """Whether each suffix a:end_a has exactly the first common values of b:end_b, and sorts no later than it."""
    n, last = len(a), len(codes) - 1
    if not n:
        return True
    shift = b - a
    order = np.lexsort((a, shift))
    x, d, e = a[order], shift[order], (a + common)[order]
    # of spans at the same distance, only what reaches beyond the ones before is new
    new = np.append(True, d[1:] != d[:-1])
    base = np.cumsum(new) * (len(codes) + 1)
    reach = np.maximum.accumulate(e + base) - base
    x = np.where(new, x, np.maximum(x, np.append(0, reach[:-1])))
    use = np.flatnonzero(x < e)
    cuts = np.unique(np.append(np.searchsorted(np.cumsum((e - x)[use]), np.arange(0, int((e - x)[use].sum()) + 1, 1 << 22)), [0, len(use)]))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # bounds the arrays
        u = use[lo:hi]
        if (gather(codes, x[u], e[u]) != gather(codes, x[u] + d[u], e[u] + d[u])).any():
            return False
    room_a, room_b = end_a - a - common, end_b - b - common
    inside = (room_a > 0) & (room_b > 0)
    next_a, next_b = codes[np.minimum(a + common, last)], codes[np.minimum(b + common, last)]
    return bool(np.where(inside, next_a < next_b, room_a <= room_b).all())


def sorted_groups(prefix: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sort_groups' order and the common prefixes of neighbours in it (0 across groups), verified."""
    for compare in (lambda: prefix, lambda: Ranks(codes, int((end - start).max()))):
        by = compare()
        order = sort_groups(by, codes, start, end, first)
        a, e = start[order], end[order]
        common = common_prefix(by, a[:-1], a[1:], np.minimum(e[:-1] - a[:-1], e[1:] - a[1:]))
        within = np.ones(len(common), bool)
        within[first[1:-1] - 1] = False
        common[~within] = 0
        if neighbours_hold(codes, a[:-1][within], a[1:][within], e[:-1][within], e[1:][within], common[within]):
            break
    return order, common
