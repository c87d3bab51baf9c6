"""Plans of path searches on tables of requests; their oracles keep the search's table by key in a recursion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tectra.operators import per_image as one
from tectra.plans import registry as base
from tectra.plans import sql
from tectra.plans.registry import KEY, plan
from tectra.sources import rasters as src

#: Places that a search may leave behind.
CAP = 1000


def search_sql(around: list[tuple[int, int]], cap: int = CAP) -> str:
    """result (req, status, expanded, path), of reqs (req, image_id, sy, sx, gy, gx) on cost (image_id, y, x, cost)."""
    guess = lambda y, x, q: f"sqrt(CAST(({y} - {q}gy) * ({y} - {q}gy) + ({x} - {q}gx) * ({x} - {q}gx) AS DOUBLE))"
    near = ", ".join(map(str, around))
    return f"""node(req, y, x, g, by_, bx, closed, f) USING KEY (req, y, x) AS (
            SELECT req, sy, sx, CAST(0 AS DOUBLE), NULL::INTEGER, NULL::INTEGER, false, {guess("sy", "sx", "")} FROM reqs UNION ALL
            (WITH top AS (SELECT req, min({{'f': f, 'y': y, 'x': x}}) FILTER (NOT closed) AS b, count(*) FILTER (closed) AS n FROM recurring.node GROUP BY req),
             cur AS (SELECT t.req, k.y, k.x, k.g, k.by_, k.bx, k.f, q.image_id, q.gy, q.gx FROM top t JOIN recurring.node k ON k.req = t.req AND k.y = t.b.y AND k.x = t.b.x
                JOIN reqs q ON q.req = t.req WHERE t.n <= {cap} AND NOT (k.y = q.gy AND k.x = q.gx))
             SELECT req, y, x, g, by_, bx, true, f FROM cur UNION ALL
             SELECT n.req, n.y, n.x, n.g, n.by_, n.bx, coalesce(o.closed, false), n.g + {guess("n.y", "n.x", "n.")}
             FROM (SELECT c.req, p.y, p.x, c.g + p.cost AS g, c.y AS by_, c.x AS bx, c.gy, c.gx FROM cur c, (VALUES {near}) d(dy, dx) JOIN cost p ON p.image_id = c.image_id AND p.y = c.y + d.dy AND p.x = c.x + d.dx) n
             LEFT JOIN recurring.node o ON o.req = n.req AND o.y = n.y AND o.x = n.x WHERE o.g IS NULL OR n.g < o.g)),
        ends_ AS (SELECT q.req, q.sy, q.sx, q.gy, q.gx, count(*) FILTER (closed) AS expanded, count(*) FILTER (NOT closed) AS left_,
            (min({{'f': f, 'y': y, 'x': x}}) FILTER (NOT closed)).y = gy AND (min({{'f': f, 'y': y, 'x': x}}) FILTER (NOT closed)).x = gx AS found FROM reqs q JOIN node n ON n.req = q.req GROUP BY q.req, q.sy, q.sx, q.gy, q.gx),
        way AS (SELECT e.req, n.y, n.x, n.by_, n.bx, 0 AS k FROM ends_ e JOIN node n ON n.req = e.req AND n.y = e.gy AND n.x = e.gx WHERE e.found
            UNION ALL SELECT w.req, n.y, n.x, n.by_, n.bx, w.k + 1 FROM way w JOIN node n ON n.req = w.req AND n.y = w.by_ AND n.x = w.bx),
        walked AS (SELECT req, string_agg(y || ' ' || x, ',' ORDER BY k DESC) AS path FROM way GROUP BY 1),
        result AS (SELECT e.req, CASE WHEN found THEN 'found' WHEN left_ = 0 THEN 'none' ELSE 'stopped' END AS status, CAST(expanded AS INTEGER) AS expanded, coalesce(path, sy || ' ' || sx) AS path FROM ends_ e LEFT JOIN walked USING (req))"""


def traced(cost: DataFrame, requests: DataFrame, cap: int = CAP, around: list[tuple[int, int]] = one.AROUND) -> DataFrame:
    """(req, status, expanded, path) of requests (req, image_id, sy, sx, gy, gx) on cost (image_id, y, x, v): one image
    with its requests is one group.  path is 'y x,y x ...'."""
    one.reachable(cost.sparkSession)

    def work(key, px, asked):
        grid = one.grid(px) if len(px) else None
        rows = []
        for q in asked.itertuples():
            if grid is None:
                continue
            status, expanded, path = one.trace(grid, (q.sy, q.sx), (q.gy, q.gx), cap, around)
            rows.append((q.req, status, expanded, ",".join(f"{y} {x}" for y, x in path)))
        return pd.DataFrame(rows, columns=["req", "status", "expanded", "path"])

    return cost.groupBy("image_id").cogroup(requests.groupBy("image_id")).applyInPandas(work, "req long, status string, expanded int, path string")


_COST = "cost AS MATERIALIZED (SELECT image_id, y, x, 1 - v / 255.0::DOUBLE AS cost FROM {0})"
_CORNERS = "reqs AS MATERIALIZED (SELECT image_id AS req, image_id, 0 AS sy, 0 AS sx, CAST(max(y) {0} AS INTEGER) AS gy, CAST(max(x) {0} AS INTEGER) AS gx FROM u8 GROUP BY 1)"


def _corners(px: DataFrame, part: str) -> DataFrame:
    return px.groupBy("image_id").agg(F.expr(f"cast(max(y) {part} as int)").alias("gy"), F.expr(f"cast(max(x) {part} as int)").alias("gx")).select(F.col("image_id").alias("req"), "image_id", F.lit(0).alias("sy"), F.lit(0).alias("sx"), "gy", "gx")


def _cost(px: DataFrame) -> DataFrame:
    return px.select(*KEY, (1 - F.col("v") / F.lit(255.0)).alias("v"))


@plan(f"WITH RECURSIVE {sql.U8}, {_COST.format('u8')}, {_CORNERS.format('')}, {search_sql(one.AROUND)} SELECT req AS image_id, status, expanded, path FROM result")
def astar_path(spark, sf):
    """From corner to corner, eight neighbours."""
    px = base._u8(spark, sf)
    return traced(_cost(px), _corners(px, "")).withColumnRenamed("req", "image_id")


@plan(f"WITH RECURSIVE {sql.U8}, {_COST.format('u8')}, {_CORNERS.format('// 4')}, {search_sql(one.CROSS)} SELECT req AS image_id, status, expanded, path FROM result")
def astar_four(spark, sf):
    """From a corner into the image, four neighbours."""
    px = base._u8(spark, sf)
    return traced(_cost(px), _corners(px, "div 4"), around=one.CROSS).withColumnRenamed("req", "image_id")


_CLICKS = """click AS (SELECT user_id, CAST(hour(ts) * 2 AS INTEGER) AS x, CAST(floor(value) AS INTEGER) % 50 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down FROM events WHERE event_type = 'click'),
    reqs AS MATERIALIZED (SELECT a.user_id AS req, a.user_id % 8 AS image_id, a.y AS sy, a.x AS sx, b.y AS gy, b.x AS gx FROM click a JOIN click b ON a.user_id = b.user_id AND a.up = 1 AND b.down = 1)"""


@plan(f"WITH RECURSIVE {sql.U8}, edge_ AS ({base.ORACLES['sobel_mag_l2']}), {_COST.format('edge_')}, {_CLICKS}, {search_sql(one.AROUND)} SELECT req, status, expanded, list_reduce(list_transform(string_split(path, ','), lambda p: string_split(p, ' ')[2] || ' ' || string_split(p, ' ')[1]), lambda a, b: a || ',' || b) AS path FROM result JOIN reqs USING (req) WHERE image_id IN (SELECT image_id FROM cost)")
def trace_requests(spark, sf):
    """Semi-automatic tracing: two clicks (x, y) of each user are a request, the cost comes from the gradient, and the
    way goes back as x y."""
    clicks = src.table(spark, sf, "events").filter("event_type = 'click'").select("user_id", "ts", "event_id", (F.hour("ts") * 2).alias("x"), (F.floor("value").cast("int") % 50).alias("y"))
    w = W.partitionBy("user_id")
    both = clicks.withColumns({"up": F.row_number().over(w.orderBy("ts", "event_id")), "down": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))})
    at = lambda flag, c: F.max(F.when(F.col(flag) == 1, F.col(c)))
    asked = both.groupBy("user_id").agg(at("up", "y").alias("sy"), at("up", "x").alias("sx"), at("down", "y").alias("gy"), at("down", "x").alias("gx"))
    asked = asked.select(F.col("user_id").alias("req"), (F.col("user_id") % 8).alias("image_id"), "sy", "sx", "gy", "gx")
    found = traced(_cost(base.sobel_mag_l2(spark, sf)), asked)
    turned = F.transform(F.split("path", ","), lambda p: F.concat_ws(" ", F.split(p, " ")[1], F.split(p, " ")[0]))
    return found.withColumn("path", F.array_join(turned, ","))
