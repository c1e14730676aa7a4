"""Whether a ring crosses itself, by a tree of boxes over its edges in order.

Each node has the box of a run of edges, twice as many at each level. The tree is joined with itself from the root down: pairs of nodes whose boxes don't
meet are left at once, and pairs of edges that meet are tested. Runs that follow one another are near, so of a ring of n points that doesn't
cross itself some n log n pairs are looked at. Pairs are taken in batches, the deepest first, so few are held, and the first crossing ends the search.
"""

from __future__ import annotations

import numpy as np

BATCH = 1 << 18


def crossing(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether edges i and j (from points i and j on) cross: the ends of each are on different sides of the other."""
    a, b, c, d = p[i], p[i + 1], p[j], p[j + 1]

    def turn(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (v[:, 0] - u[:, 0]) * (w[:, 1] - u[:, 1]) - (v[:, 1] - u[:, 1]) * (w[:, 0] - u[:, 0])

    return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)


def crosses_itself(points: np.ndarray) -> bool:
    """points: x and y of a closed ring. Only edges that aren't neighbours count, and touching isn't crossing."""
    p = np.asarray(points, float)
    n = len(p) - 1
    if n < 4:
        return False
    size = 1 << (n - 1).bit_length()
    low, high = np.full((size, 2), np.inf), np.full((size, 2), -np.inf)
    low[:n], high[:n] = np.minimum(p[:-1], p[1:]), np.maximum(p[:-1], p[1:])
    levels = [(low, high)]
    while len(levels[-1][0]) > 1:
        low, high = levels[-1]
        levels.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > BATCH:
            half = len(i) // 2
            todo += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        low, high = levels[level]
        meet = ((low[i] <= high[j]) & (low[j] <= high[i])).all(axis=1)
        i, j = i[meet], j[meet]
        if level:
            # the parts of both; of a node with itself each pair once
            x, y = np.repeat(2 * i, 4) + np.tile([0, 0, 1, 1], len(i)), np.repeat(2 * j, 4) + np.tile([0, 1, 0, 1], len(j))
            once = x <= y
            if once.any():
                todo.append((level - 1, x[once], y[once]))
            continue
        apart = (j - i > 1) & ~((i == 0) & (j == n - 1))
        if crossing(p, i[apart], j[apart]).any():
            return True
    return False
