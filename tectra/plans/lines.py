"""Plans of polylines as tables: unit vectors, connections, deviations, paths, vertex edits, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tectra.operators import raster as ops
from tectra.plans import registry as base
from tectra.plans import sql
from tectra.plans.registry import ORACLES, plan
from tectra.sources import rasters as src

_STEP = "CAST(r - pr AS DOUBLE) AS a, CAST(c - pc AS DOUBLE) AS b"


@plan(f"WITH {base._STEPS}, v AS (SELECT edge_id, i, {_STEP} FROM st WHERE pr IS NOT NULL) SELECT edge_id, i, CASE WHEN a <> 0 OR b <> 0 THEN round(a / sqrt(a * a + b * b), 6) END + 0 AS dr, CASE WHEN a <> 0 OR b <> 0 THEN round(b / sqrt(a * a + b * b), 6) END + 0 AS dc FROM v")
def unit_vectors(spark, sf):
    """Directions of the steps of lines; null where a point repeats."""
    a, b = (F.col("r") - F.col("pr")).cast("double"), (F.col("c") - F.col("pc")).cast("double")
    size = F.sqrt(a * a + b * b)
    one = lambda v: F.when(size > 0, F.round(v / size, 6) + 0.0)
    return base._steps(spark, sf).filter("pr is not null").select("edge_id", "i", one(a).alias("dr"), one(b).alias("dc"))


_NODES = sql.ENDS + """, node AS (SELECT e.edge_id, e."end", d.n - 1 AS links FROM ends e JOIN (SELECT r, c, count(*) AS n FROM ends GROUP BY 1, 2) d ON e.r = d.r AND e.c = d.c),
    pair AS (SELECT edge_id, max(links) FILTER ("end" = 0) AS at_start, max(links) FILTER ("end" = 1) AS at_end FROM node GROUP BY 1)"""


@plan(f"""WITH {_NODES} SELECT edge_id, at_start, at_end, CASE WHEN at_start = 0 AND at_end >= 1 THEN at_end WHEN at_start >= 1 AND at_end = 0 THEN at_start ELSE 0 END AS spur_degree,
    CASE WHEN at_start = 0 AND at_end >= 1 THEN 1 WHEN at_start >= 1 AND at_end = 0 THEN 0 ELSE -1 END AS spur_end FROM pair""")
def connection_info(spark, sf):
    """Links of both ends of a line; of a spur (links at one end only) how many, and at which end (-1: no spur)."""
    e = ops.ends(src.coarse_edges(spark, sf))
    links = e.join(e.groupBy("r", "c").agg((F.count(F.lit(1)) - 1).alias("links")), ["r", "c"])
    at = lambda k: F.max(F.when(F.col("end") == k, F.col("links")))
    pair = links.groupBy("edge_id").agg(at(0).alias("at_start"), at(1).alias("at_end"))
    first, last = F.expr("at_start >= 1 and at_end = 0"), F.expr("at_start = 0 and at_end >= 1")
    degree = F.when(last, F.col("at_end")).when(first, F.col("at_start")).otherwise(0).cast("long")
    return pair.select("edge_id", "at_start", "at_end", degree.alias("spur_degree"), F.when(last, 1).when(first, 0).otherwise(-1).alias("spur_end"))


_CHORD = f"""{sql.EDGES}, z AS (SELECT edge_id, arg_min(r, i) AS r1, arg_min(c, i) AS c1, arg_max(r, i) AS r2, arg_max(c, i) AS c2 FROM pt GROUP BY 1),
    s AS (SELECT *, sqrt(CAST((r2 - r1) * (r2 - r1) + (c2 - c1) * (c2 - c1) AS DOUBLE)) AS chord FROM z),
    d AS (SELECT pt.edge_id, i, chord, CASE WHEN chord = 0 THEN sqrt(CAST((r - r1) * (r - r1) + (c - c1) * (c - c1) AS DOUBLE)) ELSE abs((r2 - r1) * (c - c1) - (c2 - c1) * (r - r1)) / chord END AS away FROM pt JOIN s USING (edge_id))"""


@plan(f"WITH {_CHORD}, k AS (SELECT edge_id, any_value(chord) AS chord, sum(away * away) AS squares, max({{'d': round(away, 4), 'i': -i}}) AS b FROM d GROUP BY 1) SELECT edge_id, b.d AS deviation, -b.i AS at, round(chord, 4) AS chord, round(squares, 2) AS squares FROM k")
def line_deviation(spark, sf):
    """Largest distance from the chord, its first place, the chord's length, and the sum of all squared distances."""
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    e = src.event_edges(spark, sf).withColumns({"r1": first["r"], "c1": first["c"], "dr": last["r"] - first["r"], "dc": last["c"] - first["c"]})
    v = e.withColumn("chord", F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))).select("edge_id", "r1", "c1", "dr", "dc", "chord", F.posexplode("pts").alias("i", "p"))
    y, x = F.col("p.r") - F.col("r1"), F.col("p.c") - F.col("c1")
    v = v.withColumn("away", F.when(F.col("chord") == 0, F.sqrt((y * y + x * x).cast("double"))).otherwise(F.abs(F.col("dr") * x - F.col("dc") * y) / F.col("chord")))
    best = F.max(F.struct(F.round("away", 4).alias("d"), (-F.col("i")).alias("i"))).alias("b")
    k = v.groupBy("edge_id").agg(F.first("chord").alias("chord"), F.sum(F.col("away") * F.col("away")).alias("squares"), best)
    return k.select("edge_id", F.col("b.d").alias("deviation"), (-F.col("b.i")).alias("at"), F.round("chord", 4).alias("chord"), F.round("squares", 2).alias("squares"))


def parse_paths(paths: DataFrame, key: str = "edge_id") -> DataFrame:
    """(key, i, x, y) of SVG paths with M, L, H, V and Z, in any case; curves give no points and leave the place as it
    is.  M and L take pairs, H and V one number a point, Z comes back to the path's first point."""
    commands = F.regexp_extract_all(F.upper("path"), F.lit("[MLHVCSQTAZ][^MLHVCSQTAZ]*"), F.lit(0))
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda n: n.cast("double"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def more(acc, c):
        kind = F.substring(c, 1, 1)

        def added(n):
            pairs = F.transform(F.filter(n, lambda _, i: i % 2 == 0), lambda x, i: point(x, F.get(n, 2 * i + 1)))
            level = F.transform(n, lambda x: point(x, acc["now"]["y"]))
            upright = F.transform(n, lambda y: point(acc["now"]["x"], y))
            none = F.slice(acc["points"], F.lit(1), F.lit(0))
            return F.when(kind.isin("M", "L"), pairs).when(kind == "H", level).when(kind == "V", upright).when(kind == "Z", F.slice(acc["points"], F.lit(1), F.lit(1))).otherwise(none)

        step = lambda p: F.struct(F.concat(acc["points"], p).alias("points"), F.when((F.size(p) > 0) & (kind != "Z"), F.element_at(p, -1)).otherwise(acc["now"]).alias("now"))
        return ops.let(ops.let(numbers(c), added), step)

    start = F.expr("named_struct('points', cast(array() as array<struct<x:double,y:double>>), 'now', named_struct('x', 0D, 'y', 0D))")
    found = paths.select(key, F.aggregate(commands, start, more)["points"].alias("points"))
    return found.select(key, F.posexplode("points").alias("i", "p")).select(key, "i", "p.x", "p.y")


_WRITTEN = f"""{base._STEPS}, cmd AS (SELECT edge_id, i, CASE WHEN i = 0 THEN 'M ' || c || ' ' || r WHEN r = pr THEN 'H ' || c WHEN c = pc THEN 'V ' || r WHEN i % 3 = 0 THEN 'l ' || c || ' ' || r ELSE 'L ' || c || ' ' || r END AS cmd, c, r FROM st)"""


@plan(f"WITH {_WRITTEN}, n AS (SELECT edge_id, count(*) AS n FROM cmd GROUP BY 1) SELECT edge_id, i, CAST(c AS DOUBLE) AS x, CAST(r AS DOUBLE) AS y FROM cmd UNION ALL SELECT edge_id, CAST(n AS INTEGER), CAST(c AS DOUBLE), CAST(r AS DOUBLE) FROM cmd JOIN n USING (edge_id) WHERE i = 0")
def svg_parse_commands(spark, sf):
    """Lines written with all straight commands and a curve, and read again."""
    v = base._steps(spark, sf)
    place = lambda k, *c: F.concat_ws(" ", F.lit(k), *(F.col(x).cast("string") for x in c))
    command = F.when(F.col("i") == 0, place("M", "c", "r")).when(F.col("r") == F.col("pr"), place("H", "c")).when(F.col("c") == F.col("pc"), place("V", "r")).when(F.col("i") % 3 == 0, place("l", "c", "r")).otherwise(place("L", "c", "r"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", command.alias("s")))), lambda p: p["s"]), " ")
    return parse_paths(v.groupBy("edge_id").agg(F.concat(text, F.lit(" C 1 2 3 4 5 6 Z")).alias("path")))


ORACLES["edge_order"] = f"WITH {sql.BIN} SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS place FROM bin WHERE v = 1"


@plan(ORACLES["edge_order"])
def edge_order(spark, sf):
    """Set pixels numbered row by row, the order in which all walks visit them."""
    return base._bin(spark, sf).filter("v = 1").select("image_id", "y", "x", F.row_number().over(W.partitionBy("image_id").orderBy("y", "x")).alias("place"))
