"""Operators that need a whole image or line at a time: one image per Arrow-backed group."""

from __future__ import annotations

import heapq
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Row-major order of the eight neighbours; every walk and tie follows it.
AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def grid(pdf: pd.DataFrame, value: str = "v", fill: float = 0) -> np.ndarray:
    out = np.full((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), fill, float)
    out[pdf["y"], pdf["x"]] = pdf[value]
    return out


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (top, env.get("PYTHONPATH", "")) if x)


def per_image(px: DataFrame, work, schema: str) -> DataFrame:
    """work(image_id, pdf) -> rows, for every image."""
    reachable(px.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, pdf):
        return pd.DataFrame(work(key[0], pdf.sort_values(["y", "x"], ignore_index=True)), columns=names)

    return px.groupBy("image_id").applyInPandas(run, schema)


def ring(b: np.ndarray) -> np.ndarray:
    """The eight neighbours clockwise from north, zero outside."""
    p = np.pad(b, 1)
    h, w = b.shape
    return np.stack([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))])


def skeleton(b: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning until nothing changes."""
    b = b.astype(np.int8)
    while True:
        before = b.copy()
        for first in (True, False):
            n = ring(b)
            count = n.sum(axis=0)
            turns = ((n == 0) & (np.roll(n, -1, axis=0) == 1)).sum(axis=0)
            north, east, south, west = n[0], n[2], n[4], n[6]
            one, two = (north * east * south, east * south * west) if first else (north * east * west, north * south * west)
            b[(b == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (one == 0) & (two == 0)] = 0
        if (b == before).all():
            return b.astype(bool)


def components(b: np.ndarray, around=AROUND) -> np.ndarray:
    """Components, 8-connected by default, labelled by their first pixel in row-major order, -1 outside."""
    h, w = b.shape
    label = np.where(b, np.arange(h * w).reshape(h, w), h * w)
    while True:
        p = np.pad(label, 1, constant_values=h * w)
        low = np.minimum.reduce([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in [(0, 0), *around]])
        low = np.where(b, low, h * w)
        hop = np.append(low.ravel(), h * w)[low]
        if (hop == label).all():
            return np.where(b, label, -1)
        label = hop


def hysteresis(flags: np.ndarray) -> np.ndarray:
    """Weak pixels that touch a strong one, however far along."""
    label = components(flags > 0)
    return np.isin(label, np.unique(label[flags == 2])) & (flags > 0)


def length(path) -> float:
    p = np.asarray(path, float)
    return float(np.hypot(*np.diff(p, axis=0).T).sum()) if len(p) > 1 else 0.0


def area(ring) -> float:
    """Signed area of a closed ring (first point repeated)."""
    x, y = np.asarray(ring, float).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def is_simple(ring) -> bool:
    """No two sides of a closed ring meet but neighbours at their common point."""
    p = np.asarray(ring, float)
    a, b, n = p[:-1], p[1:], len(p) - 1

    def side(u, v, w):
        return np.sign((v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0]))

    for i in range(n):
        j = np.array([k for k in range(i + 2, n) if (k + 1) % n != i], int)
        if len(j):
            crossed = (side(a[i], b[i], a[j]) * side(a[i], b[i], b[j]) <= 0) & (side(a[j], b[j], a[i]) * side(a[j], b[j], b[i]) <= 0)
            apart = (np.maximum(a[j], b[j]) < np.minimum(a[i], b[i])).any(axis=1) | (np.minimum(a[j], b[j]) > np.maximum(a[i], b[i])).any(axis=1)
            if (crossed & ~apart).any():
                return False
    return True


#: Row-major order of the four near neighbours.
CROSS = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def trace(cost: np.ndarray, start: tuple[int, int], goal: tuple[int, int], cap: int = 1000, around=AROUND) -> tuple[str, int, list[tuple[int, int]]]:
    """A*: a step costs what it enters, the guess is the straight distance.  Gives found, none (no way) or stopped
    (more than cap places were left behind), the number of those places, and the way (the start alone
    where none is found).  Of equal sums the first place in row-major order comes first; steps cheaper than their
    length make the guess too high, so a way need not be the cheapest."""

    def guess(p) -> float:
        return float(np.sqrt((p[0] - goal[0]) ** 2 + (p[1] - goal[1]) ** 2))

    best, back, closed = {start: 0.0}, {}, set()
    heap = [(guess(start), start)]
    while heap:
        _, p = heapq.heappop(heap)
        if p in closed:
            continue
        if p == goal:
            path = [p]
            while path[-1] in back:
                path.append(back[path[-1]])
            return "found", len(closed), path[::-1]
        if len(closed) > cap:
            return "stopped", len(closed), [start]
        closed.add(p)
        for dy, dx in around:
            q = p[0] + dy, p[1] + dx
            if 0 <= q[0] < cost.shape[0] and 0 <= q[1] < cost.shape[1]:
                g = best[p] + float(cost[q])
                if g < best.get(q, np.inf):
                    best[q], back[q] = g, p
                    heapq.heappush(heap, (g + guess(q), q))
    return "none", len(closed), [start]
