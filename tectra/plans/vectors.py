"""Plans from rasters to lines: borders, contours, simplified lines, polygons, paths; their oracles follow borders and
split lines by recursion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tectra.operators import borders as bd
from tectra.operators import per_image as one
from tectra.plans import registry as base
from tectra.plans import sql
from tectra.plans.registry import plan
from tectra.sources import rasters as src


def border_sql(source: str) -> str:
    """chain (image_id, border, i, n, x, y): the points of all borders of source (v 0 or 1), i from 0, each distinct
    from its neighbours; borders (image_id, border, area)."""
    step = "(VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)) {0}(d, dy, dx)"
    at = "LEFT JOIN {0} {1} ON {1}.image_id = s.image_id AND {1}.y = s.y + {2} AND {1}.x = s.x + {3}"
    return f"""on_ AS MATERIALIZED (SELECT image_id, y, x FROM {source} WHERE v = 1), wide AS (SELECT image_id, max(x) + 1 AS w FROM {source} GROUP BY 1),
        side AS MATERIALIZED (SELECT o.image_id, o.y, o.x, t.d, t.dy, t.dx, a.dy AS ay, a.dx AS ax, (o.y * w + o.x) * 4 + t.d AS id, w FROM on_ o JOIN wide USING (image_id), {step.format("t")}, {step.format("a")}
            WHERE a.d = (t.d + 1) % 4 AND NOT EXISTS (SELECT 1 FROM on_ q WHERE q.image_id = o.image_id AND q.y = o.y + t.dy AND q.x = o.x + t.dx)),
        succ AS MATERIALIZED (SELECT s.image_id, s.id, s.y, s.x, s.d, CASE WHEN c.x IS NOT NULL THEN (c.y * s.w + c.x) * 4 + (s.d + 3) % 4 WHEN f.x IS NOT NULL THEN (f.y * s.w + f.x) * 4 + s.d ELSE (s.y * s.w + s.x) * 4 + (s.d + 1) % 4 END AS after
            FROM side s {at.format("on_", "c", "s.ay + s.dy", "s.ax + s.dx")} {at.format("on_", "f", "s.ay", "s.ax")}),
        trail AS (SELECT image_id, id AS border, id, 0 AS i, after FROM succ UNION ALL
            SELECT t.image_id, t.border, s.id, t.i + 1, s.after FROM trail t JOIN succ s ON s.image_id = t.image_id AND s.id = t.after WHERE t.after > t.border),
        round_ AS MATERIALIZED (SELECT t.image_id, t.border, t.i, s.y, s.x, s.d FROM trail t JOIN (SELECT image_id, border FROM trail WHERE after = border) USING (image_id, border) JOIN succ s USING (image_id, id)),
        borders AS (SELECT image_id, border, CAST(sum(CASE d WHEN 1 THEN x + 1 WHEN 3 THEN -x ELSE 0 END) AS BIGINT) AS area FROM round_ GROUP BY 1, 2),
        moved AS (SELECT *, coalesce(lag(x) OVER o, last(x) OVER w) AS px, coalesce(lag(y) OVER o, last(y) OVER w) AS py, count(*) OVER w AS k FROM round_ WINDOW o AS (PARTITION BY image_id, border ORDER BY i), w AS (PARTITION BY image_id, border ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        chain AS MATERIALIZED (SELECT image_id, border, CAST(row_number() OVER (PARTITION BY image_id, border ORDER BY i) - 1 AS INTEGER) AS i, x, y FROM (SELECT *, max(CASE WHEN px <> x OR py <> y THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, border) AS any_ FROM moved) WHERE px <> x OR py <> y OR (any_ = 0 AND i = 0))"""


_CORNERS = """turns AS (SELECT *, count(*) OVER w AS n, coalesce(lag(x) OVER o, last(x) OVER w) AS px, coalesce(lag(y) OVER o, last(y) OVER w) AS py, coalesce(lead(x) OVER o, first(x) OVER w) AS nx, coalesce(lead(y) OVER o, first(y) OVER w) AS ny
        FROM chain WINDOW o AS (PARTITION BY image_id, border ORDER BY i), w AS (PARTITION BY image_id, border ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    corner AS MATERIALIZED (SELECT image_id, border, CAST(row_number() OVER (PARTITION BY image_id, border ORDER BY i) - 1 AS INTEGER) AS i, x, y FROM turns WHERE n < 3 OR x - px <> nx - x OR y - py <> ny - y)"""

_AWAY = """round(CASE WHEN a.x = b.x AND a.y = b.y THEN sqrt(CAST((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y) AS DOUBLE))
    ELSE abs((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) / sqrt(CAST((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS DOUBLE)) END, 6)"""


def split_sql(points: str, parts: str, name: str) -> str:
    """name (line, i): points that Douglas and Peucker keep of points (line, i, x, y), from parts (line, a, b, tol)."""
    return f"""{name}_r AS (SELECT line, a, b, tol FROM {parts} UNION ALL SELECT line, CASE s.k WHEN 0 THEN a ELSE mid END, CASE s.k WHEN 0 THEN mid ELSE b END, tol FROM
            (SELECT r.line, r.a, r.b, r.tol, -max({{'d': {_AWAY}, 'i': -p.i}}).i AS mid, max({_AWAY}) AS worst FROM {name}_r r
             JOIN {points} a ON a.line = r.line AND a.i = r.a JOIN {points} b ON b.line = r.line AND b.i = r.b JOIN {points} p ON p.line = r.line AND p.i > r.a AND p.i < r.b
             GROUP BY r.line, r.a, r.b, r.tol) w, (VALUES (0), (1)) s(k) WHERE worst > tol),
        {name} AS (SELECT line, a AS i FROM {name}_r UNION SELECT line, b FROM {name}_r)"""


_BORDERS = f"{sql.BIN}, {border_sql('bin')}"
_POINT = "image_id long, border int, area long, i int, x int, y int"


def border_points(px: DataFrame) -> DataFrame:
    """(image_id, border, area, i, x, y): corners of all borders, outer ones and holes."""

    def work(image_id, pdf):
        rows = []
        for border, area, points in bd.borders(one.grid(pdf) > 0):
            rows += [(image_id, border, area, i, x, y) for i, (x, y) in enumerate(bd.corners(points).tolist())]
        return rows

    return one.per_image(px, work, _POINT)


@plan(f"WITH RECURSIVE {_BORDERS}, {_CORNERS} SELECT image_id, CAST(border AS INTEGER) AS border, area, i, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM corner JOIN borders USING (image_id, border)")
def contours(spark, sf):
    """Borders of the set pixels as chains of corners."""
    return border_points(base._bin(spark, sf))


_LINES = f"""{_BORDERS}, {_CORNERS}, pts AS MATERIALIZED (SELECT {{'g': image_id, 'b': border}} AS line, i, x, y FROM corner),
    steps AS (SELECT line, i, sqrt(CAST((x - lag(x) OVER o) * (x - lag(x) OVER o) + (y - lag(y) OVER o) * (y - lag(y) OVER o) AS DOUBLE)) AS d FROM pts WINDOW o AS (PARTITION BY line ORDER BY i)),
    parts AS (SELECT line, 0 AS a, CAST(max(i) AS INTEGER) AS b, round(0.01::DOUBLE * sum(d), 6) AS tol FROM steps GROUP BY 1 HAVING count(*) > 1), {split_sql('pts', 'parts', 'kept')},
    line_ AS (SELECT line, i, x, y, sqrt(CAST((x - lag(x) OVER o) * (x - lag(x) OVER o) + (y - lag(y) OVER o) * (y - lag(y) OVER o) AS DOUBLE)) AS d FROM pts JOIN kept USING (line, i) WINDOW o AS (PARTITION BY line ORDER BY i)),
    lines AS (SELECT line, count(*) AS points, round(sum(d), 4) AS length, string_agg(x || ' ' || y, ', ' ORDER BY i) AS path FROM line_ GROUP BY 1 HAVING round(sum(d), 6) > 10)"""


def raster_lines(px: DataFrame, share: float = 0.01, least: float = 10.0) -> DataFrame:
    """(image_id, border, points, length, path): borders as open lines, simplified within a share of their length; those
    no longer than least are left out.  path is 'x y, x y ...'."""

    def work(image_id, pdf):
        rows = []
        for border, _, points in bd.borders(one.grid(pdf) > 0):
            line = bd.corners(points)
            if len(line) > 1:
                line = bd.simplified(line, round(share * bd.length(line), 6))
                if round(bd.length(line), 6) > least:
                    rows.append((image_id, border, len(line), round(bd.length(line), 4), ", ".join(f"{x} {y}" for x, y in line.tolist())))
        return rows

    return one.per_image(px, work, "image_id long, border int, points long, length double, path string")


@plan(f"WITH RECURSIVE {_LINES} SELECT line.g AS image_id, CAST(line.b AS INTEGER) AS border, points, length, 'LINESTRING (' || path || ')' AS wkt FROM lines")
def simplify(spark, sf):
    """Contours to line strings: simplified within a hundredth of their length, longer than 10."""
    return raster_lines(base._bin(spark, sf)).select("image_id", "border", "points", "length", F.concat(F.lit("LINESTRING ("), "path", F.lit(")")).alias("wkt"))


@plan(f"WITH RECURSIVE {_LINES}, b AS (SELECT image_id, count(*) AS contours, count(*) FILTER (area < 0) AS holes FROM borders GROUP BY 1), l AS (SELECT line.g AS image_id, count(*) AS lines, CAST(sum(points) AS BIGINT) AS points FROM lines GROUP BY 1) SELECT image_id, contours, holes, lines, points FROM b JOIN l USING (image_id)")
def line_totals(spark, sf):
    """Contours, holes among them, lines that are long enough, and their points, of every image."""
    px = base._bin(spark, sf)
    all_ = border_points(px).select("image_id", "border", "area").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("contours"), F.sum((F.col("area") < 0).cast("long")).alias("holes"))
    lines = raster_lines(px).groupBy("image_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("points").alias("points"))
    return all_.join(lines, "image_id").select("image_id", "contours", "holes", "lines", "points")


_RINGS = f"""{_BORDERS}, {_CORNERS}, pts0 AS (SELECT {{'g': image_id, 'b': border}} AS line, i, x, y FROM corner),
    pts AS MATERIALIZED (SELECT * FROM pts0 UNION ALL SELECT a.line, CAST(n AS INTEGER), a.x, a.y FROM pts0 a JOIN (SELECT line, count(*) AS n FROM pts0 GROUP BY 1) c USING (line) WHERE a.i = 0 AND n > 1),
    steps AS (SELECT line, i, sqrt(CAST((x - lag(x) OVER o) * (x - lag(x) OVER o) + (y - lag(y) OVER o) * (y - lag(y) OVER o) AS DOUBLE)) AS d FROM pts WINDOW o AS (PARTITION BY line ORDER BY i)),
    far AS (SELECT p.line, -max({{'d': round(sqrt(CAST((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y) AS DOUBLE)), 6), 'i': -p.i}}).i AS far FROM pts p JOIN pts a ON a.line = p.line AND a.i = 0 GROUP BY 1),
    whole AS (SELECT line, CAST(max(i) AS INTEGER) AS b, round(0.01::DOUBLE * sum(d), 6) AS tol FROM steps GROUP BY 1 HAVING count(*) > 3),
    parts AS (SELECT line, CASE s.k WHEN 0 THEN 0 ELSE far END AS a, CASE s.k WHEN 0 THEN far ELSE b END AS b, tol FROM whole JOIN far USING (line), (VALUES (0), (1)) s(k)), {split_sql('pts', 'parts', 'kept')},
    ring AS (SELECT k.line, k.i, x, y FROM kept k JOIN whole w USING (line) JOIN pts USING (line, i) WHERE k.i < w.b UNION ALL SELECT p.line, p.i, x, y FROM pts0 p WHERE p.line NOT IN (SELECT line FROM whole))"""


def raster_rings(px: DataFrame, share: float = 0.01) -> DataFrame:
    """(image_id, border, area, corners, x, y arrays): closed contours, simplified within a share of their length; area
    is that of the border before."""

    def work(image_id, pdf):
        rows = []
        for border, area, points in bd.borders(one.grid(pdf) > 0):
            ring = bd.corners(points)
            if len(ring) > 2:
                ring = bd.simplified_ring(ring, round(share * bd.length(np.vstack([ring, ring[:1]])), 6))
            rows.append((image_id, border, area, len(ring), ring[:, 0].tolist(), ring[:, 1].tolist()))
        return rows

    return one.per_image(px, work, "image_id long, border int, area long, corners int, x array<int>, y array<int>")


@plan(f"WITH RECURSIVE {_RINGS} SELECT line.g AS image_id, CAST(line.b AS INTEGER) AS border, 'M ' || string_agg(x || ' ' || y, ' L ' ORDER BY i) || ' Z' AS path FROM ring GROUP BY 1, 2")
def contour_paths(spark, sf):
    """Closed contours as SVG paths, simplified within a hundredth of their length."""
    pairs = F.transform(F.arrays_zip("x", "y"), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return raster_rings(base._bin(spark, sf)).select("image_id", "border", F.concat(F.lit("M "), F.array_join(pairs, " L "), F.lit(" Z")).alias("path"))


_OUTER = f"""{_RINGS}, frame_ AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM bin GROUP BY 1),
    ground AS MATERIALIZED (SELECT f.image_id, y.i - 1 AS y, x.i - 1 AS x FROM frame_ f, range(66) y(i), range(66) x(i) LEFT JOIN on_ o ON o.image_id = f.image_id AND o.y = y.i - 1 AND o.x = x.i - 1 WHERE y.i <= h + 1 AND x.i <= w + 1 AND o.x IS NULL),
    sea AS (SELECT image_id, y, x FROM ground WHERE y = -1 AND x = -1 UNION SELECT g.image_id, g.y, g.x FROM sea s JOIN ground g ON g.image_id = s.image_id AND abs(g.y - s.y) + abs(g.x - s.x) = 1),
    shore AS (SELECT DISTINCT r.image_id, r.border FROM round_ r JOIN sea s ON s.image_id = r.image_id AND s.y = r.y + CASE r.d WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END AND s.x = r.x + CASE r.d WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END),
    poly AS (SELECT line, CAST(row_number() OVER (PARTITION BY line ORDER BY i) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY line) AS n, x, y FROM ring JOIN shore s ON s.image_id = line.g AND s.border = line.b),
    seg AS (SELECT a.line, a.i, a.n, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM poly a JOIN poly b ON b.line = a.line AND b.i = (a.i + 1) % a.n WHERE a.n >= 3),
    cross_ AS (SELECT DISTINCT p.line FROM seg p JOIN seg q ON q.line = p.line AND q.i > p.i + 1 AND (q.i + 1) % p.n <> p.i
        WHERE sign((p.bx - p.ax) * (q.ay - p.ay) - (p.by_ - p.ay) * (q.ax - p.ax)) * sign((p.bx - p.ax) * (q.by_ - p.ay) - (p.by_ - p.ay) * (q.bx - p.ax)) <= 0
        AND sign((q.bx - q.ax) * (p.ay - q.ay) - (q.by_ - q.ay) * (p.ax - q.ax)) * sign((q.bx - q.ax) * (p.by_ - q.ay) - (q.by_ - q.ay) * (p.bx - q.ax)) <= 0
        AND greatest(p.ax, p.bx) >= least(q.ax, q.bx) AND greatest(q.ax, q.bx) >= least(p.ax, p.bx) AND greatest(p.ay, p.by_) >= least(q.ay, q.by_) AND greatest(q.ay, q.by_) >= least(p.ay, p.by_))"""


@plan(f"""WITH RECURSIVE {_OUTER} SELECT line.g AS image_id, CAST(line.b AS INTEGER) AS border, count(*) AS corners, 'POLYGON ((' || string_agg(x || ' ' || y, ', ' ORDER BY i) || ', ' || arg_min(x || ' ' || y, i) || '))' AS wkt
    FROM poly WHERE n >= 3 AND line NOT IN (SELECT line FROM cross_) GROUP BY 1, 2""")
def outer_polygons(spark, sf):
    """Outer borders that no other component surrounds, simplified within a hundredth of their length; those with
    under three corners or with crossing sides are left out."""

    def work(image_id, pdf):
        b = one.grid(pdf) > 0
        p = np.pad(b, 1)
        sea = one.components(~p, [(-1, 0), (0, -1), (0, 1), (1, 0)]) == 0
        rows = []
        for border, area, points in bd.borders(b):
            y, x, d = border // 4 // b.shape[1], border // 4 % b.shape[1], border % 4
            dy, dx = bd._STEPS[d]
            if not sea[y + 1 + dy, x + 1 + dx]:
                continue
            ring = bd.corners(points)
            if len(ring) > 2:
                ring = bd.simplified_ring(ring, round(0.01 * bd.length(np.vstack([ring, ring[:1]])), 6))
            closed = [*map(tuple, ring.tolist()), tuple(ring[0].tolist())]
            if len(ring) > 2 and one.is_simple(closed):
                rows.append((image_id, border, len(ring), "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in closed) + "))"))
        return rows

    return one.per_image(base._bin(spark, sf), work, "image_id long, border int, corners long, wkt string")


_PIECES = f"""{sql.EDGES}, pts AS MATERIALIZED (SELECT edge_id AS line, i, c AS x, r AS y FROM pt), ends_ AS MATERIALIZED (SELECT line, max(i) AS z FROM pts GROUP BY 1),
    cut AS (SELECT line, 0 AS a, z AS b, false AS put, 0 AS k FROM ends_ UNION ALL SELECT line, CASE WHEN fits THEN b ELSE a END, CASE WHEN fits THEN z ELSE mid END, fits, k + 1 FROM
        (SELECT r.line, r.a, r.b, r.k, e.z, -max({{'d': {_AWAY}, 'i': -p.i}}).i AS mid, max({_AWAY}) <= 4 * (10 - exp(-sum({_AWAY} * {_AWAY}))) / (10 + exp(-sum({_AWAY} * {_AWAY}))) AS fits
         FROM cut r JOIN ends_ e ON e.line = r.line JOIN pts a ON a.line = r.line AND a.i = r.a JOIN pts b ON b.line = r.line AND b.i = r.b JOIN pts p ON p.line = r.line AND p.i >= r.a AND p.i <= r.b
         WHERE r.a < e.z GROUP BY r.line, r.a, r.b, r.k, e.z) w)"""


@plan(f"WITH RECURSIVE {_PIECES}, kept AS (SELECT line, 0 AS i FROM ends_ UNION SELECT line, a FROM cut WHERE put) SELECT line AS edge_id, i, y AS r, x AS c FROM kept JOIN pts USING (line, i)")
def segment_list(spark, sf):
    """Lines cut into straight pieces that stay within 4, with the tolerance fading in by the sum of squares."""
    def work(pdfs):
        for pdf in pdfs:
            rows = []
            for edge, pts in zip(pdf["edge_id"], pdf["pts"], strict=True):
                p = np.array([(q["c"], q["r"]) for q in pts])
                place = bd.segmented_places(p, 4.0)
                rows += [(edge, i, int(p[i, 1]), int(p[i, 0])) for i in place]
            yield pd.DataFrame(rows, columns=["edge_id", "i", "r", "c"])

    one.reachable(spark)
    return src.event_edges(spark, sf).mapInPandas(work, "edge_id long, i int, r int, c int")
