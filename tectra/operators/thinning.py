"""Thinning of binary images (numpy, one image a call)."""

from __future__ import annotations

import numpy as np

from tectra.operators.per_image import ring


def thin(b: np.ndarray) -> np.ndarray:
    """Guo and Hall's two-subiteration thinning until nothing changes."""
    b = b.astype(np.int8)
    while True:
        before = b.copy()
        for first in (True, False):
            n, ne, e, se, s, sw, w, nw = ring(b)
            crossings = (1 - n) * (ne | e) + (1 - e) * (se | s) + (1 - s) * (sw | w) + (1 - w) * (nw | n)
            sides = np.minimum((nw | n) + (ne | e) + (se | s) + (sw | w), (n | ne) + (e | se) + (s | sw) + (w | nw))
            held = ((s | sw | (1 - nw)) & w) if first else ((n | ne | (1 - se)) & e)
            b[(b == 1) & (crossings == 1) & (sides >= 2) & (sides <= 3) & (held == 0)] = 0
        if (b == before).all():
            return b.astype(bool)


def distance(b: np.ndarray) -> np.ndarray:
    """Steps to the background by any of eight neighbours; beyond the border is background."""
    left, out = b.astype(bool), np.zeros(b.shape, int)
    while left.any():
        out += left
        left = left & (ring(left.astype(np.int8)).sum(axis=0) == 8)
    return out


def medial_axis(b: np.ndarray) -> np.ndarray:
    """Distance-ordered thinning: pixels are visited once, by distance to the background and then row by
    row, and leave if they have two neighbours or more and their removal parts or joins nothing (one
    change from background, in the four near places, to foreground around them)."""
    far = distance(b)
    grid = np.pad(b.astype(bool), 1)
    order = sorted(map(tuple, np.argwhere(b).tolist()), key=lambda p: (far[p], p))
    for y, x in order:
        n, ne, e, se, s, sw, w, nw = (bool(grid[y + 1 + dy, x + 1 + dx]) for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)))
        turns = (not n and (ne or e)) + (not e and (se or s)) + (not s and (sw or w)) + (not w and (nw or n))
        if turns == 1 and n + ne + e + se + s + sw + w + nw >= 2:
            grid[y + 1, x + 1] = False
    return grid[1:-1, 1:-1]
