"""Plans of filters and views of an image: gradients of any size, wide blurs, tiles, colours, spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tectra.operators import per_image as one
from tectra.operators import raster as ops
from tectra.plans import registry as base
from tectra.plans import sql
from tectra.plans.registry import KEY, ORACLES, plan
from tectra.plans.thinning import _CANNY, on_grid

SIZES = (1, 7, 31)


def _size_sql(k: int) -> str:
    slope, smooth = ops.binomial(max(k, 3), True), ops.binomial(k, False)
    return f"{base._separable_sql(f'a{k}', slope, smooth)}, {base._separable_sql(f'b{k}', smooth, slope)}"


@plan(f"WITH {sql.U8}, {', '.join(map(_size_sql, SIZES))} " + " UNION ALL ".join(f"SELECT {k} AS ksize, image_id, y, x, round(a.s / {4.0 ** k!r}::DOUBLE, 6) + 0 AS gx, round(b.s / {4.0 ** k!r}::DOUBLE, 6) + 0 AS gy FROM a{k} a JOIN b{k} b USING (image_id, y, x)" for k in SIZES))
def sobel_sizes(spark, sf):
    """Gradients of sizes 1, 7 and 31, over the fourth power of two of the size."""
    px, out = base._u8(spark, sf), None
    for k in SIZES:
        g = ops.sobel_of_size(px, k)
        g = g.select(F.lit(k).alias("ksize"), *KEY, *((F.round(F.col(c) / 4.0**k, 6) + 0.0).alias(c) for c in ("gx", "gy")))
        out = g if out is None else out.unionByName(g)
    return out


_G49, _G17 = ops.gaussian(6.0, 24), ops.gaussian(2.0, 8)


@plan(f"WITH {sql.U8}, {base._separable_sql('sm', _G49, _G49, 'replicate')} SELECT image_id, y, x, round(s, 4) AS v FROM sm")
def gaussian_sigma6(spark, sf):
    """Sigma 6, cut at four sigmas, border pixels repeated."""
    return ops.separable(base._u8(spark, sf), _G49, _G49, border="replicate").select(*KEY, F.round("s", 4).alias("v"))


_SMOOTH = f"{sql.U8}, {base._separable_sql('sm', _G17, _G17, 'replicate')}, soft AS (SELECT image_id, y, x, CAST(floor(round(s, 6) + 0.5) AS INTEGER) AS v FROM sm)"


@plan(f"""WITH RECURSIVE {_SMOOTH}, {sql.canny(26, 51).removeprefix(sql.U8 + ", ").replace("FROM u8 ", "FROM soft ")}, grow AS (SELECT image_id, y, x FROM flags WHERE flag = 2
    UNION SELECT f.image_id, f.y, f.x FROM grow g JOIN flags f ON f.image_id = g.image_id AND abs(f.y - g.y) <= 1 AND abs(f.x - g.x) <= 1) SELECT image_id, y, x FROM grow""")
def canny_sigma2(spark, sf):
    """Canny after a blur of sigma 2, with thresholds of a tenth and a fifth of the gray range."""
    soft = ops.separable(base._u8(spark, sf), _G17, _G17, border="replicate").select(*KEY, F.floor(F.round("s", 6) + 0.5).cast("int").alias("v"))
    return base._hysteresis(ops.canny_flags(soft, 26, 51))


_TURN = ["nw", "w", "sw", "s", "se", "e", "ne", "n"]


def tile(px: DataFrame, start: int = 0) -> DataFrame:
    """px with tile, its eight neighbours as an array, anticlockwise from the upper left or from start."""
    order = [_TURN[(k + start) % 8] for k in range(8)]
    return ops.neighbours(px, "zero").select(*KEY, F.array(*order).alias("tile"))


@plan(f"WITH {sql.U8}, {sql.nine('u8', 'n9', 'zero')} SELECT s.k AS start, image_id, y, x, CASE s.k WHEN 0 THEN concat_ws(',', nw, w, sw, s, se, e, ne, n) ELSE concat_ws(',', s, se, e, ne, n, nw, w, sw) END AS tile FROM n9, (VALUES (0), (3)) s(k)".replace("nw, w, sw, s, se", "nw, w, sw, n9.s, se").replace("concat_ws(',', s,", "concat_ws(',', n9.s,"))
def neighbour_tile(spark, sf):
    px = base._u8(spark, sf)
    views = [tile(px, k).select(F.lit(k).alias("start"), *KEY, F.array_join("tile", ",").alias("tile")) for k in (0, 3)]
    return views[0].unionByName(views[1])


@plan(f"WITH {sql.U8} SELECT image_id, y, x, v AS r, v AS g, v AS b FROM u8")
def gray_to_rgb(spark, sf):
    px = base._u8(spark, sf).withColumn("rgb", F.array_repeat("v", 3))
    return px.select(*KEY, *(F.get("rgb", F.lit(i)).alias(c) for i, c in enumerate("rgb")))


ORACLES["curvature_index"] = f"WITH c AS ({ORACLES['curvature']}) SELECT image_id, y, x, CAST(CASE WHEN curvature < 0 THEN -1 ELSE floor(round(least(curvature, 10) * 255 / 10, 6)) END AS INTEGER) AS place FROM c"


@plan(ORACLES["curvature_index"])
def curvature_index(spark, sf):
    """Places in a colour table of 256: curvatures are cut at 10, those not defined are -1."""
    place = F.floor(F.round(F.least(F.col("curvature"), F.lit(10.0)) * 255 / 10, 6))
    return base.curvature(spark, sf).select(*KEY, F.when(F.col("curvature") < 0, -1).otherwise(place).cast("int").alias("place"))


_ABS = base.ORACLES["sobel_mag_abs"].removeprefix("WITH ")
_SOBEL_ABS = _ABS[: _ABS.index("SELECT image_id, y, x, CAST(least")] + ", sobel_c AS (" + _ABS[_ABS.index("SELECT image_id, y, x, CAST(least") :] + ")"


def filtered(spark, sf, name: str) -> DataFrame:
    """One of the filters by its name in the export dialog, as an 8-bit image."""
    if name == "Original":
        return base._u8(spark, sf)
    if name == "Canny":
        return on_grid(base._u8(spark, sf), base.canny_edges(spark, sf)).withColumn("v", F.col("v") * 255)
    if name == "Sobel":
        return base.sobel_mag_abs(spark, sf)
    if name == "Shearlet":
        from tectra.plans import spectral

        return spectral.edge_bytes(spark, sf)
    raise ValueError(f"no filter {name}")


def binarised(px: DataFrame, how: str) -> DataFrame:
    """px as 0 and 255, by Otsu's threshold or by the adaptive one."""
    if how == "otsu":
        return px.join(ops.histogram_otsu(px), "image_id").select(*KEY, F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))
    if how == "adaptive":
        g = ops.gaussian(2.0, 5)
        return ops.separable(px, g, g, border="replicate").select(*KEY, F.when(F.col("v") > F.round("s", 6) - 2, 255).otherwise(0).alias("v"))
    raise ValueError(f"no threshold {how}")


@plan(f"WITH RECURSIVE {_CANNY}, {_SOBEL_ABS.removeprefix(sql.SOBEL).lstrip(' ,')} SELECT 'Original' AS filter, image_id, y, x, v FROM u8 UNION ALL SELECT 'Canny', image_id, y, x, v * 255 FROM edge UNION ALL SELECT 'Sobel', image_id, y, x, v FROM sobel_c")
def filter_select(spark, sf):
    """The dispatch by filter name; the fourth, Shearlet, has a query of its own."""
    parts = [filtered(spark, sf, k).select(F.lit(k).alias("filter"), *KEY, "v") for k in ("Original", "Canny", "Sobel")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@plan(f"WITH o AS (SELECT * FROM (WITH {sql.OTSU} SELECT u8.image_id, y, x, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM u8 JOIN otsu USING (image_id))), a AS ({ORACLES['adaptive_threshold']}) SELECT 'otsu' AS how, * FROM o UNION ALL SELECT 'adaptive', * FROM a")
def binarise_select(spark, sf):
    px = base._u8(spark, sf)
    parts = [binarised(px, k).select(F.lit(k).alias("how"), *KEY, "v") for k in ("otsu", "adaptive")]
    return parts[0].unionByName(parts[1])


@plan(f"""WITH RECURSIVE {_CANNY}, {sql.nine('edge', 'e9', 'none')} SELECT p.image_id, p.y, p.x, CAST(least(255, round_even(0.7::DOUBLE * p.v + 0.3::DOUBLE * e.v * 255, 0)) AS INTEGER) AS v,
    CAST(CASE WHEN e.se IS NULL THEN 0 ELSE e.c + 2 * e.e + 4 * e.se + 8 * e.s END AS INTEGER) AS line FROM u8 p JOIN e9 e ON e.image_id = p.image_id AND e.y = p.y AND e.x = p.x""")
def overlay_compare(spark, sf):
    """The image blended with its edges, and the code of the iso-line cell at each pixel (0 or 15: none)."""
    px = base._u8(spark, sf)
    near = ops.neighbours(on_grid(px, base.canny_edges(spark, sf)), "none")
    code = F.when(F.col("se").isNull(), 0).otherwise(F.col("c") + 2 * F.col("e") + 4 * F.col("se") + 8 * F.col("s"))
    both = px.join(near.select(*KEY, F.col("c").alias("edge"), code.cast("int").alias("line")), KEY)
    return both.select(*KEY, F.least(F.lit(255.0), F.rint(F.lit(0.7) * F.col("v") + F.lit(0.3) * F.col("edge") * 255)).cast("int").alias("v"), "line")


# -- spectra


def dft_sql(n: str, name: str) -> str:
    """Cosines and sines of all products of two places, as lists by the first, for every size in n (CTE with n)."""
    return f"""{name} AS (SELECT n, a.i AS k, list(cos(2 * pi() * ((a.i * b.i) % n) / n) ORDER BY b.i) AS c, list(sin(2 * pi() * ((a.i * b.i) % n) / n) ORDER BY b.i) AS s
        FROM {n}, range(64) a(i), range(64) b(i) WHERE a.i < n AND b.i < n GROUP BY 1, 2)"""


_DFT = f"""{sql.U8}, size AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM u8 GROUP BY 1), sizes AS (SELECT h AS n FROM size UNION SELECT w FROM size), {dft_sql('sizes', 'wave')},
    rows_ AS (SELECT image_id, y, list(CAST(v AS DOUBLE) ORDER BY x) AS v FROM u8 GROUP BY 1, 2),
    f1 AS (SELECT r.image_id, f.k AS fx, list(list_dot_product(r.v, f.c) ORDER BY r.y) AS re, list(-list_dot_product(r.v, f.s) ORDER BY r.y) AS im
        FROM rows_ r JOIN size z USING (image_id) JOIN wave f ON f.n = z.w GROUP BY 1, 2),
    f2 AS (SELECT g.image_id, h, w, f.k AS fy, fx, list_dot_product(re, f.c) + list_dot_product(im, f.s) AS re, list_dot_product(im, f.c) - list_dot_product(re, f.s) AS im
        FROM f1 g JOIN size z USING (image_id) JOIN wave f ON f.n = z.h)"""
ORACLES["fft_magnitude"] = f"WITH {_DFT} SELECT image_id, CAST((fy + h // 2) % h AS INTEGER) AS y, CAST((fx + w // 2) % w AS INTEGER) AS x, round(ln(sqrt(re * re + im * im) + 1), 6) AS v FROM f2"


@plan("SELECT t.n, CAST(i AS INTEGER) AS i, round(2 * pi() / t.n * CASE WHEN i <= (t.n - 1) // 2 THEN i ELSE i - t.n END, 9) AS omega FROM (VALUES (1), (2), (5), (52), (64)) t(n), range(64) r(i) WHERE i < t.n")
def pulsation(spark, sf):
    """Angular frequencies of a transform of n places, in its order."""
    n = spark.createDataFrame([(k,) for k in (1, 2, 5, 52, 64)], "n int")
    row = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    turn = F.when(F.col("i") <= F.expr("(n - 1) div 2"), F.col("i")).otherwise(F.col("i") - F.col("n"))
    return row.select("n", "i", F.round(2 * np.pi / F.col("n") * turn, 9).alias("omega"))


@plan(f"WITH {sql.U8}, z AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM u8 GROUP BY 1) SELECT image_id, k, y, CAST(((x + k * (h // 2 - y)) % w + w) % w AS INTEGER) AS x, v FROM u8 JOIN z USING (image_id), (VALUES (-2), (1)) s(k)")
def shear_rows(spark, sf):
    """Every row rolled round by k times its distance from the middle row."""
    px = base._u8(spark, sf).withColumns({"h": F.max("y").over(ops.over_image()) + 1, "w": F.max("x").over(ops.over_image()) + 1})
    px = px.withColumn("k", F.explode(F.array(F.lit(-2), F.lit(1))))
    return px.select("image_id", "k", "y", F.expr("pmod(x + k * (h div 2 - y), w)").cast("int").alias("x"), "v")
