"""Point operators, reductions and stencils over pixel tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

NINE = ("nw", "n", "ne", "w", "c", "e", "sw", "s", "se")


def along_row() -> WindowSpec:
    return W.partitionBy("image_id", "y").orderBy("x")


def over_image() -> WindowSpec:
    return W.partitionBy("image_id")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(px: DataFrame, along: str = "x") -> DataFrame:
    """(image_id, y or x, cells): the pixels of each line in order, all their columns in a struct.

    Pixels that are partitioned by image_id (as sources give them) are not shuffled."""
    other = "y" if along == "x" else "x"
    rest = [c for c in px.columns if c not in ("image_id", "y", "x")]
    return px.groupBy("image_id", other).agg(F.sort_array(F.collect_list(F.struct(along, *rest))).alias("cells"))


def neighbours(px: DataFrame, border: str = "reflect", value: str = "v") -> DataFrame:
    """px with the eight neighbours and c.  Beyond the border they are 0 (zero), the border pixel
    (replicate), the pixel on its other side (reflect) or null (none).

    Lines of pixels are arrays: a step along a line shifts its array, a step across is the array of the
    line before or after, so windows see one row a line."""
    kind = px.schema[value].dataType
    n = F.size("c")

    def end(near: Column, far: Column) -> Column:
        """What stands beside a line's end; near and far are places from 1."""
        held = {"zero": F.array(F.lit(0).cast(kind)), "none": F.array(F.lit(None).cast(kind)), "replicate": F.slice("c", near, F.lit(1))}
        return held[border] if border in held else F.slice("c", F.when(n > 1, far).otherwise(near), F.lit(1))

    row = lines(px).withColumn("c", F.col("cells")[value])
    row = row.withColumn("w", F.concat(end(F.lit(1), F.lit(2)), F.slice("c", F.lit(1), n - 1)))
    row = row.withColumn("e", F.concat(F.slice("c", F.lit(2), n - 1), end(n, n - 1)))
    across = over_image().orderBy("y")
    outside = {"zero": F.lit(0).cast(kind), "none": F.lit(None).cast(kind)}

    def beside(name: str, step, back) -> Column:
        near = step(name).over(across)
        if border in outside:
            return F.coalesce(near, F.array_repeat(outside[border], n))
        return F.coalesce(near, F.col(name)) if border == "replicate" else F.coalesce(near, back(name).over(across), F.col(name))

    up = {"nw": "w", "n": "c", "ne": "e"}
    down = {"sw": "w", "s": "c", "se": "e"}
    more = {k: beside(v, F.lag, F.lead) for k, v in up.items()} | {k: beside(v, F.lead, F.lag) for k, v in down.items()}
    # n is the number of columns until here; the neighbour n comes last under its own name.
    row = row.withColumns({f"_{k}": v for k, v in more.items()})
    zipped = F.arrays_zip("cells", "c", "w", "e", *(f"_{k}" for k in more))
    flat = row.select("image_id", "y", F.inline(zipped))
    return flat.select("image_id", "y", "cells.*", "c", "w", "e", *(F.col(f"_{k}").alias(k) for k in more)).select("image_id", "y", "x", *[c for c in px.columns if c not in ("image_id", "y", "x")], *NINE)


def sobel(px: DataFrame) -> DataFrame:
    """gx and gy of the 3x3 operator, reflected at the border."""
    n = neighbours(px)
    gx = F.col("ne") + 2 * F.col("e") + F.col("se") - F.col("nw") - 2 * F.col("w") - F.col("sw")
    gy = F.col("sw") + 2 * F.col("s") + F.col("se") - F.col("nw") - 2 * F.col("n") - F.col("ne")
    return n.select("image_id", "y", "x", "v", gx.alias("gx"), gy.alias("gy"))


def weighted(px: DataFrame, weights: list[float], along: str, value: str, out: str, border: str) -> DataFrame:
    """px with out, a one-dimensional pass of odd length over value, along x or y.

    Beyond the ends of a line, reflect mirrors it without the edge pixel (again and again, if it is
    short), replicate repeats the edge pixel."""
    half = len(weights) // 2
    row = lines(px, along)
    values, n = F.col("cells")[value], F.size("cells")

    def place(j: Column) -> Column:
        if border == "replicate":
            return F.greatest(F.lit(0), F.least(j, n - 1))
        turn = F.pmod(j, F.greatest(F.lit(1), 2 * (n - 1)))
        return F.when(n == 1, 0).otherwise(F.least(turn, 2 * (n - 1) - turn))

    padded = F.transform(F.sequence(F.lit(-half), n - 1 + half), lambda j: F.get(values, place(j)))
    taps = [(k, w) for k, w in enumerate(weights) if w]
    passed = let(padded, lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda i: reduce(Column.__add__, [F.lit(float(w)) * F.get(p, i + k) for k, w in taps])))
    other = "y" if along == "x" else "x"
    flat = row.withColumn("passed", passed).select("image_id", other, F.inline(F.arrays_zip("cells", "passed")))
    return flat.select("image_id", other, "cells.*", F.col("passed").alias(out)).select(*px.columns, out)


def separable(px: DataFrame, across: list[float], down: list[float], out: str = "s", border: str = "reflect") -> DataFrame:
    """px with out: weights across along rows, then down along columns."""
    return weighted(weighted(px, across, "x", "v", "_h", border), down, "y", "_h", out, border).drop("_h")


def binomial(size: int, slope: bool) -> list[float]:
    """Weights of the smoothing (or first derivative) part of a Sobel operator of odd size."""
    held = [1.0]
    for step in [(1.0, 1.0)] * (size - 2 if slope else size - 1) + [(-1.0, 1.0)] * slope:
        held = [a * step[0] + b * step[1] for a, b in zip([*held, 0.0], [0.0, *held], strict=True)]
    return held[::-1] if not slope else held


def sobel_of_size(px: DataFrame, size: int) -> DataFrame:
    """px with gx and gy of the operator of any odd size; size 1 differs without smoothing."""
    slope, smooth = binomial(max(size, 3), True), binomial(size, False)
    return separable(separable(px, slope, smooth, "gx"), smooth, slope, "gy")


def gaussian(sigma: float, radius: int) -> list[float]:
    held = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(held) for w in held]


def resize(px: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, y, x, v): bilinear, pixel centres at halves, edges repeated, rounded half up.

    v is whole; weights are whole numbers over 4 * height * width, so the result is exact.  Each pixel
    of the new grid asks for its four neighbours; the only shuffles are by image and pixel."""
    size = px.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    grid = size.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))

    def taps(i: str, old: str, new: int) -> Column:
        at = F.greatest(F.lit(0), F.least((2 * F.col(i) + 1) * F.col(old) - new, 2 * new * (F.col(old) - 1))).cast("int")
        low, part = F.floor(at / (2 * new)).cast("int"), at % (2 * new)
        pair = [F.struct(low.alias("at"), (2 * new - part).alias("weight")), F.struct(F.least(low + 1, F.col(old) - 1).alias("at"), part.alias("weight"))]
        return F.filter(F.array(*pair), lambda t: t["weight"] > 0)

    asked = grid.withColumn("ty", F.explode(taps("y", "h", height))).withColumn("tx", F.explode(taps("x", "w", width)))
    asked = asked.select("image_id", F.col("y").alias("to_y"), F.col("x").alias("to_x"), F.col("ty.at").alias("y"), F.col("tx.at").alias("x"), (F.col("ty.weight") * F.col("tx.weight")).cast("long").alias("weight"))
    total = F.sum(F.col("weight") * F.col("v"))
    whole = 4 * height * width
    value = F.floor((2 * total + whole) / (2 * whole)).cast("int")
    return asked.join(px, ["image_id", "y", "x"]).groupBy("image_id", "to_y", "to_x").agg(value.alias("v")).select("image_id", F.col("to_y").alias("y"), F.col("to_x").alias("x"), "v")


def angle_split(vertices: DataFrame, gap: float, angle: float) -> DataFrame:
    """(edge_id, i, r, c, part): lines cut where a step is longer than gap, or where the angle at the
    last vertex of a part of two or more is below angle degrees (or undefined, as points repeat).

    A cut for the angle leaves a part of one vertex, so the next vertex cannot be cut for its angle:
    in a run of sharp angles every other one cuts, counted from the run's start."""
    w = W.partitionBy("edge_id").orderBy("i")
    v = vertices.select("edge_id", "i", "r", "c", *(F.lag(x, k).over(w).alias(f"{x}{k}") for x in "rc" for k in (1, 2)))
    dr, dc = F.col("r") - F.col("r1"), F.col("c") - F.col("c1")
    br, bc = F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    size = F.sqrt((dr * dr + dc * dc).cast("double")) * F.sqrt((br * br + bc * bc).cast("double"))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (dr * br + dc * bc) / size))))
    sharp = F.col("r2").isNotNull() & ((size == 0) | (turn < angle))
    far = F.col("r1").isNull() | (dr * dr + dc * dc > gap * gap)
    v = v.select("edge_id", "i", "r", "c", F.when(far, 1).when(~sharp, 0).alias("fixed"))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    base, since = F.last("fixed", True).over(run), F.col("i") - F.last(F.when(F.col("fixed").isNotNull(), F.col("i")), True).over(run)
    v = v.withColumn("cut", F.when(since % 2 == 0, base).otherwise(1 - base))
    return v.select("edge_id", "i", "r", "c", (F.sum("cut").over(run) - 1).alias("part"))


def fold_strokes(steps: DataFrame) -> DataFrame:
    """steps (owner, seq, kind, x, y) -> (owner, stroke, points, path): a press opens or extends a line, a
    release extends an open one, a commit ends it.  Lines without a commit are not finished, empty
    ones do not count."""
    w = W.partitionBy("owner").orderBy("seq")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    s = steps.withColumn("stroke", F.coalesce(F.sum((F.col("kind") == "commit").cast("long")).over(before), F.lit(0).cast("long")))
    line = W.partitionBy("owner", "stroke")
    opened = F.max((F.col("kind") == "press").cast("int")).over(line.orderBy("seq"))
    ended = F.max((F.col("kind") == "commit").cast("int")).over(line)
    s = s.withColumns({"opened": opened, "ended": ended}).filter("opened = 1 and ended = 1 and kind in ('press', 'release')")
    points = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    text = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",")
    return s.groupBy("owner", "stroke").agg(F.count(F.lit(1)).alias("points"), text.alias("path"))


def histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


def histogram_otsu(px: DataFrame) -> DataFrame:
    """image_id, threshold: the gray value with the largest between-class variance, lowest first."""
    return otsu_of(histogram(px)).select("image_id", "threshold")


def otsu_of(hist: DataFrame) -> DataFrame:
    """image_id, threshold, above, pixels, of a histogram (image_id, v, n); above is the number of pixels
    over the threshold.  The 256 rows of an image's histogram are all that the windows see."""
    up, all_ = W.partitionBy("image_id").orderBy("v"), over_image()
    sums = hist.select("image_id", "v", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"), F.sum("n").over(all_).alias("wt"), F.sum(F.col("n") * F.col("v")).over(all_).alias("st"))
    gap = F.col("s0") * F.col("wt") - F.col("st") * F.col("w0")
    rest = F.col("w0") * (F.col("wt") - F.col("w0"))
    between = F.when(rest > 0, gap.cast("double") * gap.cast("double") / rest.cast("double")).otherwise(0.0)
    best = F.max(F.struct(between.alias("b"), (-F.col("v")).alias("v"), (F.col("wt") - F.col("w0")).alias("above"), F.col("wt").alias("pixels")))
    return sums.groupBy("image_id").agg(best.alias("k")).select("image_id", (-F.col("k.v")).alias("threshold"), "k.above", "k.pixels")


def canny_flags(px: DataFrame, low: int, high: int) -> DataFrame:
    """image_id, y, x, flag (1 weak, 2 strong) of pixels that are maxima across their edge."""
    g = sobel(px).withColumn("m", F.abs("gx") + F.abs("gy"))
    n = neighbours(g, "zero", "m")
    ax, ay = F.abs("gx"), F.abs("gy")
    flat, steep = ay < ax * 0.41421356237309503, ay > ax * 2.414213562373095
    same = (F.col("gx") >= 0) == (F.col("gy") >= 0)
    a = F.when(flat, F.col("w")).when(steep, F.col("n")).when(same, F.col("nw")).otherwise(F.col("ne"))
    b = F.when(flat, F.col("e")).when(steep, F.col("s")).when(same, F.col("se")).otherwise(F.col("sw"))
    peak = (F.col("m") > a) & (F.col("m") >= b) & (F.col("m") > low)
    return n.filter(peak).select("image_id", "y", "x", F.when(F.col("m") > high, 2).otherwise(1).alias("flag"))


def crossings() -> Column:
    """Changes along the ring of the eight neighbours."""
    ring = [F.col(x) for x in ("nw", "w", "sw", "s", "se", "e", "ne", "n")]
    return reduce(Column.__add__, [F.abs(a - b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)])


#: Weights of the 3x3 neighbourhood in a table's index, column by column.
TABLE = {"nw": 256, "w": 128, "sw": 64, "n": 32, "c": 16, "s": 8, "ne": 4, "e": 2, "se": 1}


def table_index(px: DataFrame) -> DataFrame:
    """px (v 0 or 1) with idx, the place of each pixel's neighbourhood in a table of 512; 0 outside."""
    n = neighbours(px, "zero")
    return n.withColumn("idx", sum((F.col(k) * w for k, w in TABLE.items()), F.lit(0)).cast("int")).drop(*NINE)


def table_pass(px: DataFrame, table: list[int]) -> DataFrame:
    """v of every pixel replaced by the table's entry for its neighbourhood."""
    if len(table) != 512:
        raise ValueError("a table of a 3x3 neighbourhood has 512 entries")
    return table_index(px).withColumn("v", F.element_at(F.array(*map(F.lit, table)), F.col("idx") + 1)).drop("idx")


def rule_table(rule) -> list[int]:
    """rule({"nw": 0 or 1, ...}) for each of the 512 neighbourhoods."""
    return [int(rule({k: int(i & w > 0) for k, w in TABLE.items()})) for i in range(512)]


def is_border(p: dict) -> bool:
    """A pixel whose removal alone neither ends a line nor breaks one."""
    around = [p[k] for k in ("n", "ne", "e", "se", "s", "sw", "w", "nw")]
    turns = sum(a < b for a, b in zip(around, around[1:] + around[:1], strict=True))
    return p["c"] == 1 and 2 <= sum(around) <= 6 and turns == 1


def is_kept(p: dict) -> bool:
    """Of marks, those stay that have a mark above or to the left; unmarked pixels stay."""
    return p["c"] == 0 or p["n"] == 1 or p["w"] == 1


def mark_and_erase(px: DataFrame, marks: list[int], keeps: list[int]) -> DataFrame:
    """One thinning pass: pixels are marked by one table, and stay where the other allows it, given the
    marks around them.  Both tables are parameters; see rule_table."""
    marked = table_pass(px.withColumn("was", F.col("v")), marks)
    return table_pass(marked, keeps).select("image_id", "y", "x", (F.col("was") * F.col("v")).cast("int").alias("v"))


def edge_links(edges: DataFrame) -> DataFrame:
    """Ordered pairs of different ends that share a place: (edge_a, end_a, edge_b, end_b)."""
    a, b = edges.alias("a"), edges.alias("b")
    same = (F.col("a.r") == F.col("b.r")) & (F.col("a.c") == F.col("b.c"))
    other = (F.col("a.edge_id") != F.col("b.edge_id")) | (F.col("a.end") != F.col("b.end"))
    return a.join(b, same & other).select(F.col("a.edge_id").alias("edge_a"), F.col("a.end").alias("end_a"), F.col("b.edge_id").alias("edge_b"), F.col("b.end").alias("end_b"))


def ends(edges: DataFrame) -> DataFrame:
    """First (0) and last (1) vertex of every edge."""
    place = lambda p: [p["r"].alias("r"), p["c"].alias("c")]
    first = edges.select("edge_id", F.lit(0).alias("end"), *place(F.element_at("pts", 1)))
    return first.unionByName(edges.select("edge_id", F.lit(1).alias("end"), *place(F.element_at("pts", -1))))
