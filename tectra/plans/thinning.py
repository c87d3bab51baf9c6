"""Plans that thin binary images, with recursive oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tectra.operators import per_image as one
from tectra.operators import raster as ops
from tectra.operators import thinning as thins
from tectra.plans import registry as base
from tectra.plans import sql
from tectra.plans.registry import KEY, ORACLES, plan

_PLACE = "image_id long, y int, x int"


def per_pixel(px: DataFrame, work) -> DataFrame:
    """The set pixels of work(binary image), for every image of px (v 0 or 1)."""
    return one.per_image(px, lambda i, p: [(i, y, x) for y, x in np.argwhere(work(one.grid(p) > 0)).tolist()], _PLACE)


def on_grid(px: DataFrame, found: DataFrame) -> DataFrame:
    """px with v 1 at the places of found, 0 elsewhere."""
    hits = found.select(*KEY, F.lit(1).alias("hit"))
    return px.select(*KEY).join(hits, KEY, "left").select(*KEY, F.coalesce("hit", F.lit(0)).alias("v")).repartition("image_id")


ORACLES["skeleton"] = f"WITH RECURSIVE {sql.BIN}, {sql.skeleton('bin', 'sk')} SELECT image_id, y, x FROM sk WHERE v = 1"


@plan(f"WITH RECURSIVE {sql.BIN}, {sql.thin('bin', 't')} SELECT image_id, y, x FROM t WHERE v = 1")
def thin_image(spark, sf):
    """Guo and Hall's thinning to convergence."""
    return per_pixel(base._bin(spark, sf), thins.thin)


@plan(f"WITH RECURSIVE {sql.BIN}, {sql.medial('bin', 'm')} SELECT image_id, y, x FROM m WHERE v = 1")
def medial_axis(spark, sf):
    """The medial axis as distance-ordered thinning."""
    return per_pixel(base._bin(spark, sf), thins.medial_axis)


_CANNY = sql.canny(50, 150) + """, grow AS (SELECT image_id, y, x FROM flags WHERE flag = 2 UNION SELECT f.image_id, f.y, f.x FROM grow g
    JOIN flags f ON f.image_id = g.image_id AND abs(f.y - g.y) <= 1 AND abs(f.x - g.x) <= 1),
    edge AS (SELECT p.image_id, p.y, p.x, CASE WHEN g.x IS NULL THEN 0 ELSE 1 END AS v FROM u8 p LEFT JOIN grow g ON g.image_id = p.image_id AND g.y = p.y AND g.x = p.x)"""


@plan(f"""WITH RECURSIVE {_CANNY}, {sql.thin('edge', 't')} SELECT image_id, 0 AS iterations, y, x, (v * 255 * 255) % 256 AS v FROM edge WHERE v = 1
    UNION ALL SELECT image_id, n, y, x, 255 FROM t, (VALUES (1), (3)) k(n) WHERE v = 1""")
def skeletonize_iterations(spark, sf):
    """The edge view by its slider: 0 iterations wrap 255 * 255 in eight bits, more of them thin to
    convergence, so that all but the first change nothing."""
    edges = base.canny_edges(spark, sf)
    plain = edges.select("image_id", F.lit(0).alias("iterations"), "y", "x", F.pmod(F.lit(255 * 255), F.lit(256)).alias("v"))
    thinned = per_pixel(edges.withColumn("v", F.lit(1)), thins.thin)
    more = thinned.select("image_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("iterations"), "y", "x", F.lit(255).alias("v"))
    return plain.unionByName(more)


CHAIN = f"""{sql.OTSU}, cut AS (SELECT u8.image_id, y, x, CASE WHEN v > threshold THEN 1 ELSE 0 END AS v FROM u8 JOIN otsu USING (image_id)), {sql.skeleton('cut', 'sk')},
    {sql.nine('sk', 's9', 'zero')}, kept AS (SELECT image_id, y, x, CASE WHEN c = 1 AND {sql.RING} > 0 THEN 1 ELSE 0 END AS v FROM s9),
    {sql.nine('kept', 'k9', 'zero')}, marks AS (SELECT image_id, y, x, c AS was, CASE WHEN c = 1 AND {sql.RING} BETWEEN 2 AND 6 AND {sql.TURNS} = 1 THEN 1 ELSE 0 END AS v FROM k9),
    {sql.nine('marks', 'm9', 'zero')}, thinned AS (SELECT image_id, y, x, CASE WHEN was = 1 AND (c = 0 OR n = 1 OR w = 1) THEN 1 ELSE 0 END AS v FROM m9)"""


def link_input(px: DataFrame) -> DataFrame:
    """What edges are linked on: Otsu's threshold, skeleton, isolated pixels removed, one thinning pass."""
    cut = px.join(ops.histogram_otsu(px), "image_id").select(*KEY, (F.col("v") > F.col("threshold")).cast("int").alias("v"))
    bones = on_grid(cut, per_pixel(cut, one.skeleton))
    near = ops.neighbours(bones, "zero")
    kept = near.select(*KEY, F.when((F.col("c") == 1) & F.expr(f"{sql.RING} > 0"), 1).otherwise(0).alias("v"))
    return ops.mark_and_erase(kept, ops.rule_table(ops.is_border), ops.rule_table(ops.is_kept))


@plan(f"WITH RECURSIVE {CHAIN} SELECT image_id, y, x FROM thinned WHERE v = 1")
def link_preprocess(spark, sf):
    return link_input(base._u8(spark, sf)).filter("v = 1").select(*KEY)
