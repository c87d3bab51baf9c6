"""Plans of edge linking: the batch chain and the interactive one.  The oracle of what linking must keep counts on
the thinned image; edges themselves depend on order and are held by hand figures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tectra.operators import borders as bd
from tectra.operators import linking as lk
from tectra.operators import per_image as one
from tectra.operators import raster as ops
from tectra.plans import registry as base
from tectra.plans import sql
from tectra.plans.registry import KEY, plan
from tectra.plans.thinning import CHAIN, link_input, on_grid

_EDGE = "image_id long, edge_id int, etype int, pts array<array<int>>"


def _edges(px, work):
    """(image_id, edge_id, etype, pts) of work(mask) on the chain's thinned images."""
    return one.per_image(link_input(px), lambda i, p: [(i, k, t, [list(q) for q in e]) for k, (t, e) in enumerate(work(one.grid(p) > 0))], _EDGE)


@plan()
def edge_link(spark, sf):
    """Threshold, skeleton, clean, thin, link: edges with their types."""
    return _edges(base._u8(spark, sf), lk.link)


@plan()
def edge_clean(spark, sf):
    """The same, cleaned of edges shorter than 5."""
    return _edges(base._u8(spark, sf), lambda b: [(0, e) for e in lk.clean([e for _, e in lk.link(b)], 5)])


def chain(mask: np.ndarray, first: float = 5, tolerance: float = 1.5, second: float = 8) -> list:
    """Link, clean, straight pieces, clean again."""
    pieces = []
    for e in lk.clean([e for _, e in lk.link(mask)], first):
        p = np.array(e)
        pieces.append([tuple(q) for q in p[bd.segmented_places(p[:, ::-1], tolerance)].tolist()])
    return [(0, e) for e in lk.clean(pieces, second)]


@plan()
def edge_segment(spark, sf):
    """The batch chain on a blurred image: Canny, link, clean, straight pieces, clean again."""
    px = base._u8(spark, sf)
    g = ops.gaussian(2.0, 3)
    soft = ops.separable(px, g, g).select(*KEY, F.floor(F.round("s", 6) + 0.5).cast("int").alias("v"))
    hits = on_grid(px, base._hysteresis(ops.canny_flags(soft, 35, 60))).withColumn("v", F.col("v") * 255)
    return _edges(hits, chain)


@plan()
def link_interactive(spark, sf):
    """The interactive chain: Canny, 127, link; edges cut where a step is longer than 2 or turns by less than 20
    degrees, and set on the grid: the pixels of parts of two points or more."""
    px = base._u8(spark, sf)
    hits = on_grid(px, base.canny_edges(spark, sf)).withColumn("v", F.col("v") * 255)
    v = _edges(hits, lk.link).select((F.col("image_id") * 100000 + F.col("edge_id")).alias("edge_id"), F.posexplode("pts").alias("i", "p"))
    cut = ops.angle_split(v.select("edge_id", "i", F.get("p", F.lit(0)).alias("r"), F.get("p", F.lit(1)).alias("c")), 2, 20)
    long = cut.groupBy("edge_id", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return cut.join(long, ["edge_id", "part"]).select(F.expr("edge_id div 100000").alias("image_id"), F.col("r").alias("y"), F.col("c").alias("x")).distinct()


@plan(f"""WITH RECURSIVE {CHAIN}, {sql.nine('thinned', 't9', 'zero')}, kind AS (SELECT image_id, {base._CROSS} AS k FROM t9 WHERE c = 1)
    SELECT image_id, count(*) AS pixels, count(*) FILTER (k = 2) AS free_ends, count(*) FILTER (k >= 6) AS junctions, CAST(0 AS BIGINT) AS jumps, CAST(0 AS BIGINT) AS open_loops FROM kind GROUP BY 1""")
def edge_link_totals(spark, sf):
    """What linking must account for: all pixels but single junctions are on an edge or in a dropped piece; every free
    end is on one; no edge jumps, and loops end where they begin."""

    def work(image_id, pdf):
        linker = lk.Linker(one.grid(pdf) > 0)
        linker.from_ends()
        linker.from_junctions()
        dropped = linker.round_loops()
        edges = [e for _, e in linker.edges]
        covered = {p for e in edges for p in e} | set(dropped)
        jumps = sum(max(abs(a - c), abs(b - d)) > 1 for e in edges for (a, b), (c, d) in zip(e, e[1:], strict=False))
        seen = covered | linker.joint
        open_loops = sum(t == lk.LOOP and e[0] != e[-1] for t, e in linker.edges)
        return [(image_id, len(seen), len([p for p in linker.ends if p in covered]), len(linker.joints), jumps, open_loops)]

    return one.per_image(link_input(base._u8(spark, sf)), work, "image_id long, pixels long, free_ends long, junctions long, jumps long, open_loops long")
