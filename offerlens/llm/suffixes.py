"""Hash-compared suffix sorting of many small groups at once, in numpy (part of operator 1).

A suffix is a position in a byte array and a length.  Two suffixes are compared by their longest common extension,
found by binary search over prefix polynomial hashes, so a comparison takes a logarithmic number of hash look-ups.  A
bottom-up mergesort sorts all groups level by level: each item finds its place in the sibling run by binary search.
The order is then verified against the bytes themselves; a group where hashes collided is sorted anew by its bytes.
"""

from __future__ import annotations

import numpy as np

from offerlens.llm.digest import prefix, span


def extension(pre: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of positions a and b, up to most."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = span(pre, a, a + mid) == span(pre, b, b + mid)
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)
    return lo


def compare(symbols, pre, at, size, i, j):
    """-1, 0 or 1 for suffixes i against j."""
    most = np.minimum(size[i], size[j])
    n = extension(pre, at[i], at[j], most)
    ends, last = n == most, len(symbols) - 1
    by_symbol = np.sign(symbols[np.minimum(at[i] + n, last)].astype(np.int16) - symbols[np.minimum(at[j] + n, last)])
    return np.where(ends, np.sign(size[i] - size[j]), by_symbol)


def sort(symbols: np.ndarray, at: np.ndarray, size: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within their groups, and each one's common length with the one before (0 for a group's first).

    Items of a group are neighbours: item p's group is start[p]:stop[p].  Groups need not be of any order.
    """
    n, pre, order, width = len(at), prefix(symbols.astype(np.uint64) + np.uint64(1)), np.arange(len(at)), 1
    longest = int((stop - start).max()) if n else 0
    while width < longest:
        p = np.flatnonzero(stop - start > width)
        run = (p - start[p]) // width
        lo = np.minimum(start[p] + (run ^ 1) * width, stop[p])
        first, hi = lo.copy(), np.minimum(lo + width, stop[p])
        even, item = run % 2 == 0, order[p]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            c = compare(symbols, pre, at, size, item[open_], order[mid])
            right = np.where(even[open_], c > 0, c >= 0)
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
        order[start[p] + (run // 2) * 2 * width + (p - start[p] - run * width) + (lo - first)] = item
        width *= 2
    before = np.zeros(n, np.int64)
    inner = np.flatnonzero(np.arange(n) > start)
    a, b = order[inner - 1], order[inner]
    before[inner] = extension(pre, at[a], at[b], np.minimum(size[a], size[b]))
    for g in np.unique(start[inner[~verified(symbols, at, size, a, b, before[inner])]]):  # hashes collided
        items = sorted(range(g, stop[g]), key=lambda i: symbols[at[i] : at[i] + size[i]].tobytes())
        order[g : stop[g]] = items
        for k in range(g + 1, stop[g]):
            x, y = (symbols[at[i] : at[i] + size[i]] for i in items[k - g - 1 : k - g + 1])
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            before[k] = differ[0] if len(differ) else m
    return order, before


def verified(symbols: np.ndarray, at, size, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether neighbours a <= b share exactly so many symbols, by the symbols themselves."""
    ok = np.ones(len(a), bool)
    for k in range(int(common.max()) if len(common) else 0):
        p = np.flatnonzero(common > k)
        ok[p] &= symbols[at[a[p]] + k] == symbols[at[b[p]] + k]
    end = common == np.minimum(size[a], size[b])
    last = len(symbols) - 1
    less = symbols[np.minimum(at[a] + common, last)] < symbols[np.minimum(at[b] + common, last)]
    return ok & np.where(end, size[a] <= size[b], less)
