"""Borders of binary images (numpy): sides between a set pixel and a clear one, followed round.

A side is (y, x, d): the set pixel and the direction (0 up, 1 right, 2 down, 3 left) of the clear one.  With the
clear pixel on the left hand, the next side is that of the pixel ahead on the left, else of the pixel
ahead, else the next side of the same pixel; set pixels are 8-connected.  Every side lies on one border, so borders are
the cycles of a permutation, found by pointer jumping."""

from __future__ import annotations

import numpy as np

#: Steps (y, x) up, right, down, left.
_STEPS = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])


def sides(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sides as rows (y, x, d) in order, and the number of the side that follows each."""
    p = np.pad(b.astype(bool), 1)
    clear = np.stack([b & ~p[1 + dy : 1 + dy + b.shape[0], 1 + dx : 1 + dx + b.shape[1]] for dy, dx in _STEPS.tolist()], axis=-1)
    found = np.argwhere(clear)
    number = np.full((*p.shape, 4), -1)
    number[1:-1, 1:-1][clear] = np.arange(len(found))
    y, x, d = found.T
    ahead, left = _STEPS[(d + 1) % 4], _STEPS[d]
    at = np.stack([y, x], axis=1) + 1
    corner, front = at + ahead + left, at + ahead
    turn_left, go_on = p[tuple(corner.T)], p[tuple(front.T)]
    there = np.where(turn_left[:, None], corner, np.where(go_on[:, None], front, at))
    side = np.where(turn_left, (d + 3) % 4, np.where(go_on, d, (d + 1) % 4))
    return found, number[there[:, 0], there[:, 1], side]


def borders(b: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Each border as (its first side's number y * w * 4 + x * 4 + d, area, points (x, y) in order); the area is that
    of what the border goes round, below 0 for a hole.  Points are distinct from their neighbours."""
    found, after = sides(b)
    n = len(found)
    if not n:
        return []
    leader, jump = np.arange(n), after
    for _ in range(n.bit_length()):
        leader, jump = np.minimum(leader, leader[jump]), jump[jump]
    end = after == leader
    left, jump = (~end).astype(int), np.where(end, np.arange(n), after)
    for _ in range(n.bit_length()):
        left, jump = left + left[jump], jump[jump]
    order = np.lexsort((-left, leader))
    y, x, d = found[order].T
    cuts = np.flatnonzero(np.r_[True, leader[order][1:] != leader[order][:-1]])
    out = []
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True):
        points = np.stack([x[a:z], y[a:z]], axis=1)
        area = int((x[a:z] + 1)[d[a:z] == 1].sum() - x[a:z][d[a:z] == 3].sum())
        keep = (points != np.roll(points, 1, axis=0)).any(axis=1)
        keep[0] |= not keep.any()
        out.append((int((y[a] * b.shape[1] + x[a]) * 4 + d[a]), area, points[keep]))
    return out


def corners(points: np.ndarray) -> np.ndarray:
    """The points of a closed chain at which its direction changes."""
    if len(points) < 3:
        return points
    into, out = points - np.roll(points, 1, axis=0), np.roll(points, -1, axis=0) - points
    return points[(into != out).any(axis=1)]


def distances(p: np.ndarray) -> np.ndarray:
    """Distances of points from the line through the first and last (from the first, if they are one)."""
    d = (p[-1] - p[0]).astype(float)
    span = np.sqrt(d[0] * d[0] + d[1] * d[1])
    r = (p - p[0]).astype(float)
    away = np.abs(d[0] * r[:, 1] - d[1] * r[:, 0]) / span if span else np.sqrt(r[:, 0] ** 2 + r[:, 1] ** 2)
    return np.round(away, 6)


def length(p: np.ndarray) -> float:
    d = np.diff(p.astype(float), axis=0)
    return float(np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2).sum())


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker on an open line."""
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            away = distances(p[a : b + 1])
            at = a + int(away.argmax())
            if away.max() > tolerance:
                keep.add(at)
                todo += [(a, at), (at, b)]
    return p[sorted(keep)]


def simplified_ring(p: np.ndarray, tolerance: float) -> np.ndarray:
    """The same on a ring without its first point repeated: halves between the first point and the farthest."""
    if len(p) < 3:
        return p
    r = (p - p[0]).astype(float)
    far = int(np.round(np.sqrt(r[:, 0] ** 2 + r[:, 1] ** 2), 6).argmax())
    one, two = simplified(p[: far + 1], tolerance), simplified(np.vstack([p[far:], p[:1]]), tolerance)
    return np.vstack([one[:-1], two[:-1]])


def segmented_places(p: np.ndarray, tolerance: float) -> list[int]:
    """Numbers of the points kept: the first, then again and again the end of the longest fitting piece: from the last point, a piece
    shrinks to its worst point while that is farther away than tolerance * (10 - e**-s) / (10 + e**-s), s being the
    sum of the squared distances."""
    out, at = [0], 0
    while at < len(p) - 1:
        end = len(p) - 1
        while True:
            away = distances(p[at : end + 1])
            fade = np.exp(-(away**2).sum())
            if not away.max() > tolerance * (10 - fade) / (10 + fade):
                break
            end = at + int(away.argmax())
        out.append(end)
        at = end
    return out
