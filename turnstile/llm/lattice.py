"""The E8 lattice: decoding to nearest points, and the neighbours of a point.

E8 is D8 (integer vectors of even sum) and D8 shifted by one half in every coordinate.
All coordinates are doubled here, so lattice points are integer vectors.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest integer vectors of even sum: round, and where the sum is odd round the worst coordinate the other way."""
    r = np.rint(y)
    gap = y - r
    worst = np.abs(gap).argmax(1)
    row = np.arange(len(y))
    step = np.where(gap[row, worst] >= 0, 1.0, -1.0)
    odd = (r.sum(1).astype(np.int64) & 1) == 1
    r[row[odd], worst[odd]] += step[odd]
    return r


def decode(y: np.ndarray) -> np.ndarray:
    """Doubled coordinates of the E8 point nearest to each row of ``y`` (n x 8)."""
    a = _nearest_d8(y)
    b = _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(nearer[:, None], 2 * a, 2 * b).astype(np.int64)


def _shortest() -> np.ndarray:
    """The 240 shortest vectors, doubled: two entries +-2, or all entries +-1 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out, np.int64)


SHORTEST = _shortest()


def neighbours(y: np.ndarray, home: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` lattice points next to ``home`` that lie nearest to ``y`` (n x m x 8, doubled)."""
    side = (2 * y - home) @ SHORTEST.T.astype(float)
    best = np.argsort(-side, axis=1, kind="stable")[:, :m]
    return home[:, None, :] + SHORTEST[best]
