"""Locally consistent parsing of texts by restricted recompression, and hashes of their windows.

All functions work on one flat array of code points of many documents, each followed by a separator, so that numpy does
the rounds over whole blocks.
"""

from __future__ import annotations

import numpy as np

#: Runs of one symbol up to this length get a name of their own; longer ones stay single symbols, which bounds the context.
RUN = 4
#: Longest symbol that takes part in each pair round.
LIMITS = (1, 2, 2, 3, 4, 5, 7, 9, 12, 16, 16)
#: A boundary is decided by the text this far to either side: one run round and the pair rounds.
CONTEXT = RUN + 1 + sum(LIMITS)
#: No symbol is longer, so no gap between boundaries is.
GAP = 2 * LIMITS[-1]

#: Bases of the two window hashes, odd and independent of each other.
BASES = {1: 0x9E3779B97F4A7C15 // 8 * 8 + 5, 2: 0xD1B54A32D192ED03 // 8 * 8 + 3}
_SEPARATOR = 0x110000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a separator, and the start of each text (one more at the end)."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    codes = np.empty(starts[-1], np.uint32)
    joined = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes[:] = joined
    codes[starts[1:] - 1] = _SEPARATOR
    return codes, starts


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Positions in ``codes`` where a top-level symbol begins, ascending.

    Runs of equal symbols, then pairs of neighbours, get names that are hashes of their parts, hence the same wherever
    they occur, without a table of names. In a pair round a pair is joined if both symbols are short enough and a bit of
    the left name is 0 and of the right one 1. Equal substrings of at least ``2 * CONTEXT`` therefore have equal
    boundaries, but for CONTEXT symbols at either end.
    """
    name = mix(codes.astype(np.uint64) + np.uint64(1))
    at = np.arange(len(codes), dtype=np.int64)
    size = np.where(codes == _SEPARATOR, 1 << 20, 1).astype(np.int32)
    # one round of runs
    first = np.empty(len(codes), bool)
    first[:1] = True
    np.not_equal(codes[1:], codes[:-1], out=first[1:])
    head = np.flatnonzero(first)
    count = np.diff(np.append(head, len(codes)))
    whole = (count > 1) & (count <= RUN) & (codes[head] != _SEPARATOR)
    keep = np.ones(len(codes), bool)
    for k in range(2, RUN + 1):
        h = head[whole & (count == k)]
        for j in range(1, k):
            keep[h + j] = False
        name[h] = mix(name[h] + np.uint64(k))
        size[h] = k
    name, at, size = name[keep], at[keep], size[keep]
    for level, limit in enumerate(LIMITS):
        active = size <= limit
        bit = ((name * np.uint64(2 * level + 0xD6E8FEB86659FD93)) >> np.uint64(40) & np.uint64(1)).astype(bool)
        left = np.flatnonzero(active[:-1] & active[1:] & ~bit[:-1] & bit[1:])
        name[left] = mix(name[left] * np.uint64(3) + mix(name[left + 1] + np.uint64(level)))
        size[left] += size[left + 1]
        keep = np.ones(len(name), bool)
        keep[left + 1] = False
        name, at, size = name[keep], at[keep], size[keep]
    return at


class Windows:
    """Hashes of windows of a flat code array by prefix sums of a polynomial modulo 2**64, in a base of its own for each seed."""

    def __init__(self, codes: np.ndarray, seed: int):
        n = len(codes)
        base = BASES[seed]
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(seed)) * powers[:n], out=self._sum[1:])
        inverse = np.full(n + 1, pow(base, -1, 2**64), np.uint64)
        inverse[0] = 1
        self._inverse = np.cumprod(inverse)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[begin]) * self._inverse[begin])
