"""Vectorised rolling hashes and minimisers over symbol arrays, used inside tasks.

A symbol array holds bytes or word hashes as uint64.  Prefix polynomial hashes are taken modulo 2**64 with an odd
base, so the hash of any span is a difference of two prefixes times an inverse power.  Such a hash only proposes
equalities; callers either compare the symbols afterwards or pair it with a second hash of another base.
"""

from __future__ import annotations

import numpy as np

BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        both = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(max(n + 1, 1 << 16), b, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(symbols: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """Prefix hashes, one more than there are symbols."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * powers(base, len(symbols))[0][: len(symbols)], out=out[1:])
    return out


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """Unmixed hash of symbols[start:end] for arrays of positions."""
    return (pre[end] - pre[start]) * powers(base, len(pre))[1][start]


def sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over each window of so many neighbours; len(x) - width + 1 values."""
    n, out, have = len(x) - width + 1, x, 1
    while have * 2 <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[:n], out[width - have : width - have + n]) if have < width else out[:n]


#: Symbols whose windows are given owners together: a place takes POSITION_BITS bits.
POSITION_BITS = 20
PLACE = np.uint64(2**POSITION_BITS - 1)


def owners(symbols: np.ndarray, ends: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last, hash) of the grams that own windows, and the prefix hashes.

    ends: where documents end in the symbols.  A window of `window` symbols inside one document is owned by the gram in
    it whose hash is least, the leftmost of equal ones: its content alone decides, so equal windows have equal owners
    at equal places, and each window has one.  first and last are the starts of the first and last window that a gram
    owns; those between are its own too.
    """
    pre = prefix(symbols)
    n, width = len(symbols) - gram + 1, window - gram + 1
    if n < width:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), pre
    assert n <= int(PLACE) + 1
    h = mix((pre[gram:] - pre[:-gram]) * powers(BASE_A, len(pre))[1][:n])
    least = sliding(np.minimum, (h & ~PLACE) | np.arange(n, dtype=np.uint64), width)
    crossing = np.zeros(len(least) + 1, np.int32)
    inner = ends[(ends > 0) & (ends < len(symbols))]
    np.add.at(crossing, np.clip(inner - window + 1, 0, len(least)), 1)
    np.add.at(crossing, np.minimum(inner, len(least)), -1)
    start = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
    owner = (least[start] & PLACE).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    at = owner[edge]
    return at, start[edge], start[np.append(edge[1:], len(owner)) - 1] if len(edge) else edge, h[at], pre
