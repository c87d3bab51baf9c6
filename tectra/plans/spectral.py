"""Plans of the shearlet system.  Their oracles build the same filters in SQL from the formulas and transform
images by lists of cosines and sines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tectra.operators import per_image as one
from tectra.operators import raster as ops
from tectra.operators import shearlets as sh
from tectra.operators import thinning as thins
from tectra.plans import registry as base
from tectra.plans import sql
from tectra.plans.filters import _DFT
from tectra.plans.registry import KEY, plan
from tectra.plans.thinning import on_grid

_SHEARS, _FLAT = sh.cones()


def bank_sql(sizes: str) -> str:
    """bank (h, w, s, o, fy, fx, re, im), s from 0, at plain places of frequency, zeros left out; sizes gives h, w."""
    oris = ", ".join(f"({o}, {k}, {o in _FLAT}, {-1 if o > _FLAT[-1] else 1})" for o, k in enumerate(_SHEARS))
    turned = lambda f, n: f"CASE WHEN 2 * {f} >= {n} THEN {f} - {n} ELSE {f} END"
    wave = lambda at, n: f"63 * (least(h, w) / {sh.WAVELET}.0::DOUBLE) / 512 * 2 * pi() * {at} / {n} / c"
    bell = lambda at, n: f"exp(-pow(74 * (least(h, w) / {sh.GAUSSIAN}.0::DOUBLE) / 512 * 2 * pi() * (((({at}) + {n}) % (2 * {n}) + 2 * {n}) % (2 * {n}) - {n}) / (2 * {n}) / pow(c, {sh.ALPHA}), 2) / 2)"
    hat = lambda at, n: f"2 * pi() * pow({wave(at, n)}, 2) * exp(-pow({wave(at, n)}, 2) / 2) / 2"
    return f"""place AS (SELECT h, w, s, pow(2, s / 2.0::DOUBLE) AS c, y.i AS fy, x.i AS fx, {turned("y.i", "h")} AS m, {turned("x.i", "w")} AS n
            FROM {sizes}, range(7) s(s), range(64) y(i), range(64) x(i) WHERE y.i < h AND x.i < w),
        raw AS (SELECT h, w, s, o, fy, fx, sign * 2 * CASE WHEN flat THEN ({hat("m", "h")}) * {bell("2 * n - k * m", "w")} ELSE ({hat("n", "w")}) * {bell("2 * m - k * n", "h")} END AS size,
                CASE WHEN flat THEN CASE WHEN h % 2 = 0 THEN pi() * m / h ELSE 0 END ELSE CASE WHEN w % 2 = 0 THEN pi() * n / w ELSE 0 END END AS turn
            FROM place, (VALUES {oris}) r(o, k, flat, sign)
            WHERE CASE WHEN flat THEN m >= 0 AND NOT (h % 2 = 0 AND 2 * m = h) ELSE n >= 0 AND NOT (w % 2 = 0 AND 2 * n = w) END),
        unit AS (SELECT h, w, s, abs(sum(size * sin(turn + 2 * pi() * fx * (l.i - w // 2) / w)) / w) AS unit FROM raw, range(32) l(i) WHERE o = 0 AND fy = 0 AND l.i < w // 2 GROUP BY h, w, s),
        bank AS (SELECT h, w, s, o, fy, fx, size * cos(turn) / unit AS re, size * sin(turn) / unit AS im FROM raw JOIN unit USING (h, w, s))"""


_COEFFS = f"""{_DFT}, shapes AS (SELECT DISTINCT h, w FROM size), {bank_sql("shapes")},
    prod AS (SELECT image_id, f.h, f.w, s, o, f.fy, f.fx, f.re * b.re + f.im * b.im AS re, f.im * b.re - f.re * b.im AS im FROM f2 f JOIN bank b ON b.h = f.h AND b.w = f.w AND b.fy = f.fy AND b.fx = f.fx),
    every AS (SELECT image_id, h, w, s, o, y.i AS fy, x.i AS fx FROM size, range(7) s(s), range(10) o(o), range(64) y(i), range(64) x(i) WHERE y.i < h AND x.i < w),
    lists AS (SELECT image_id, h, w, s, o, fy, list(coalesce(re, 0) ORDER BY fx) AS re, list(coalesce(im, 0) ORDER BY fx) AS im FROM every LEFT JOIN prod USING (image_id, h, w, s, o, fy, fx) GROUP BY ALL),
    half AS (SELECT image_id, h, w, l.s, o, f.k AS x, list(list_dot_product(re, f.c) - list_dot_product(im, f.s) ORDER BY fy) AS re, list(list_dot_product(re, f.s) + list_dot_product(im, f.c) ORDER BY fy) AS im
        FROM lists l JOIN wave f ON f.n = l.w GROUP BY image_id, h, w, l.s, o, f.k),
    coeff AS (SELECT image_id, h, w, l.s, o, f.k AS y, x, (list_dot_product(re, f.c) - list_dot_product(im, f.s)) / (h * w) AS re, -(list_dot_product(re, f.s) + list_dot_product(im, f.c)) / (h * w) AS im
        FROM half l JOIN wave f ON f.n = l.h)"""
_LOW, _HIGH = _FLAT[0], _FLAT[-1]
_CIRCLE = f"""{_COEFFS}, circle AS (SELECT image_id, s, o, CASE WHEN o BETWEEN {_LOW} AND {_HIGH} THEN (y + 1) % h ELSE y END AS y, CASE WHEN o > {_HIGH} THEN (x - 1 + w) % w ELSE x END AS x, re, im FROM coeff
        UNION ALL SELECT image_id, s, o + 10, y, CASE WHEN o < {_LOW} THEN (x - 1 + w) % w ELSE x END, -re, -im FROM coeff),
    strong AS MATERIALIZED (SELECT a.image_id, a.y, a.x, a.s - 2 AS s, a.o, a.im AS odd, abs(b.re) AS even FROM circle a JOIN circle b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x AND b.o = a.o AND b.s = a.s - 2)"""


def _score(mode: str) -> str:
    return f"""best AS (SELECT image_id, y, x, b.odd AS top, (-b.k) // 100 AS ps, (-b.k) % 100 AS po FROM (SELECT image_id, y, x, max({{'odd': odd, 'k': -(s * 100 + o)}}) AS b FROM strong WHERE { {"all": "true", "highest": "s = 4", "lowest": "s = 1"}[mode] } GROUP BY ALL)),
    score AS (SELECT b.image_id, b.y, b.x, po, ps, top, CASE WHEN top > 0 THEN greatest(0, sum(least(odd, top) - even - 4)) / (5 * top) ELSE 0 END AS score
        FROM best b JOIN strong t ON t.image_id = b.image_id AND t.y = b.y AND t.x = b.x AND t.o = b.po GROUP BY b.image_id, b.y, b.x, po, ps, top)"""


_K = "[" + ", ".join(map(str, [*_SHEARS, 0])) + "]"
_TANGENT = f"""sides AS (SELECT image_id, y, x, po, score, top, po % 10 IN ({_LOW - 1}, {_HIGH}) AS bf, po % 10 IN ({_LOW}, {_HIGH + 1}) AS af,
        greatest(0, max(odd) FILTER (o = (po + CASE WHEN po % 10 IN ({_LOW}, {_HIGH + 1}) THEN 18 ELSE 19 END) % 20)) AS l,
        greatest(0, max(odd) FILTER (o = (po + CASE WHEN po % 10 IN ({_LOW - 1}, {_HIGH}) THEN 2 ELSE 1 END) % 20)) AS r,
        greatest(0, max(odd) FILTER (o = (po + 1) % 20)) AS up, greatest(0, max(odd) FILTER (o = (po + 19) % 20)) AS down
        FROM score JOIN strong t USING (image_id, y, x) WHERE t.s = ps GROUP BY image_id, y, x, po, score, top),
    tops AS (SELECT image_id, y, x, po, score, bf, af, CASE WHEN bf THEN up ELSE top END AS rt, CASE WHEN af THEN down ELSE top END AS lt, CASE WHEN bf THEN least(r, up) ELSE r END AS r, CASE WHEN af THEN least(l, down) ELSE l END AS l FROM sides),
    turned AS (SELECT *, CASE WHEN rt > 0 AND lt > 0 THEN r / rt > l / lt WHEN lt > 0 THEN r > 0 ELSE false END AS t FROM tops),
    mid AS (SELECT image_id, y, x, score, CASE WHEN t THEN po + CAST(bf AS INTEGER) ELSE po - CAST(af AS INTEGER) END AS mid, CASE WHEN t THEN rt ELSE lt END AS peak,
        CASE WHEN t THEN CASE WHEN lt > 0 THEN rt * l / lt END ELSE l END AS l, CASE WHEN t THEN r ELSE CASE WHEN rt > 0 THEN lt * r / rt END END AS r FROM turned),
    ori AS (SELECT image_id, y, x, score, CASE WHEN score > 0 AND 4 * peak <> 2 * (r + l) THEN mid + (r - l) / (4 * peak - 2 * (r + l)) END AS raw FROM mid),
    wrapped AS (SELECT image_id, y, x, score, raw - 10 * floor(raw / 10) AS o FROM ori),
    slope AS (SELECT image_id, y, x, score, o, degrees(atan(((1 - (o - floor(o))) * {_K}[CAST(floor(o) AS INTEGER) + 1] + (o - floor(o)) * {_K}[CAST(floor(o) AS INTEGER) + 2]) / 2)) AS k FROM wrapped),
    edged AS (SELECT image_id, y, x, score, CASE WHEN o BETWEEN {_LOW} AND {_HIGH} THEN 90 + k WHEN o < {_LOW} THEN 180 - k WHEN o > {_HIGH} THEN -k END AS angle FROM slope)"""


def _rounded(a: np.ndarray, digits: int) -> list:
    return [None if np.isnan(x) else float(x) for x in (np.round(a, digits) + 0.0).ravel().tolist()]


def _rows(image_id: int, *values: list, shape: tuple[int, int]) -> list[tuple]:
    ys, xs = (a.ravel().tolist() for a in np.indices(shape))
    return list(zip([image_id] * len(ys), ys, xs, *values, strict=True))


def detected(px: DataFrame, contrast: float = 4.0, mode: str = "all") -> DataFrame:
    """(image_id, y, x, score, angle) of every pixel; angle is null where there is no edge.  The filters of an image
    size are built once a worker."""

    def work(image_id, pdf):
        score, turn = sh.edges(one.grid(pdf), contrast, mode=mode)
        return _rows(image_id, _rounded(score, 4), _rounded(sh.degrees(turn), 2), shape=score.shape)

    return one.per_image(px, work, "image_id long, y int, x int, score double, angle double")


@plan(f"WITH {_CIRCLE}, {_score('all')}, {_TANGENT} SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(score, 4) + 0 AS score, round(angle, 2) + 0 AS angle FROM edged")
def shearlet_edges(spark, sf):
    """Edge measure and tangent direction of the 70-shearlet system."""
    return detected(base._u8(spark, sf))


@plan(f"WITH {_CIRCLE}, a AS (WITH {_score('highest')} SELECT 'highest' AS mode, * FROM score), b AS (WITH {_score('lowest')} SELECT 'lowest' AS mode, * FROM score) "
      "SELECT mode, image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(score, 4) + 0 AS score FROM (FROM a UNION ALL FROM b)")
def shearlet_modes(spark, sf):
    px = base._u8(spark, sf)
    parts = [detected(px, mode=m).select(F.lit(m).alias("mode"), *KEY, "score") for m in ("highest", "lowest")]
    return parts[0].unionByName(parts[1])


@plan(f"WITH shapes AS (SELECT 16 AS h, 12 AS w UNION ALL SELECT 12, 12), {bank_sql('shapes')} SELECT h, w, CAST(s AS INTEGER) AS scale, o AS orientation, CAST(fy AS INTEGER) AS fy, CAST(fx AS INTEGER) AS fx, round(re, 6) + 0 AS re, round(im, 6) + 0 AS im FROM bank WHERE abs(re) > 0.00001 OR abs(im) > 0.00001")
def shearlet_bank(spark, sf):
    """All filters of two small systems, at plain places of frequency."""

    def build(pdfs):
        for pdf in pdfs:
            for h, w in zip(pdf["h"], pdf["w"], strict=True):
                bank = np.fft.ifftshift(sh.edge_system(int(h), int(w)).bank, axes=(2, 3))
                at = np.argwhere((np.abs(bank.real) > 0.00001) | (np.abs(bank.imag) > 0.00001))
                held = np.round(bank[tuple(at.T)], 6)
                yield pd.DataFrame({"h": int(h), "w": int(w), "scale": at[:, 0], "orientation": at[:, 1], "fy": at[:, 2], "fx": at[:, 3], "re": held.real + 0.0, "im": held.imag + 0.0})

    one.reachable(spark)
    sizes = spark.createDataFrame([(16, 12), (12, 12)], "h int, w int")
    return sizes.mapInPandas(build, "h int, w int, scale int, orientation int, fy int, fx int, re double, im double")


@plan(f"WITH {_CIRCLE} SELECT image_id, CAST(s AS INTEGER) AS scale, o AS orientation, round(sum(re * re + im * im), 2) AS energy, round(max(im), 4) + 0 AS top, round(max(re * cos(y) * sin(x)), 4) + 0 AS mixed FROM circle GROUP BY ALL")
def shearlet_coefficients(spark, sf):
    """Of every image, scale and direction of the full circle: energy, strongest odd coefficient, and a sum that
    depends on places."""

    def work(image_id, pdf):
        v = one.grid(pdf)
        c = sh.full_circle(sh.transform(v, sh.edge_system(*v.shape)))
        y, x = np.indices(v.shape)
        energy, top, mixed = (np.abs(c) ** 2).sum(axis=(2, 3)), c.imag.max(axis=(2, 3)), (c.real * np.cos(y) * np.sin(x)).max(axis=(2, 3))
        return [(image_id, s, o, float(round(energy[s, o], 2)), float(round(top[s, o], 4) + 0.0), float(round(mixed[s, o], 4) + 0.0)) for s in range(c.shape[0]) for o in range(c.shape[1])]

    return one.per_image(base._u8(spark, sf), work, "image_id long, scale int, orientation int, energy double, top double, mixed double")


def edge_bytes(spark, sf) -> DataFrame:
    """The edge measure as 0..255, cut to whole numbers."""
    return detected(base._u8(spark, sf)).select(*KEY, F.floor(F.round(F.col("score") * 255, 4)).cast("int").alias("v"))


_BYTES = f"{_CIRCLE}, {_score('all')}, bytes AS (SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(floor(round(round(score, 4) * 255, 4)) AS INTEGER) AS v FROM score)"


@plan(f"WITH {_BYTES} SELECT image_id, y, x, v FROM bytes")
def filter_shearlet(spark, sf):
    return edge_bytes(spark, sf)


@plan(f"""WITH RECURSIVE {_CIRCLE}, {_score('all')}, {_TANGENT}, hit AS (SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN round(score, 4) > 0 THEN 1 ELSE 0 END AS v, round(score, 4) + 0 AS score, round(angle, 2) + 0 AS angle FROM edged),
    {sql.medial('hit', 'thin_')}, o AS (SELECT h.image_id, h.y, h.x, h.score, h.angle, t.v AS kept, CASE WHEN t.v = 1 THEN coalesce(h.angle, -1) ELSE -1 END AS v FROM hit h JOIN thin_ t ON t.image_id = h.image_id AND t.y = h.y AND t.x = h.x),
    {sql.nine('o', 'o9', 'none')}, l AS (SELECT *, list_filter([nw, n, ne, w, e, sw, s, se], lambda k: k >= 0) AS near, nw IS NULL OR se IS NULL OR ne IS NULL OR sw IS NULL AS border FROM o9)
    SELECT image_id, y, x, score AS edge, CASE WHEN kept = 1 THEN score END AS thin_edge, angle AS orientation,
        round(CASE WHEN border THEN 0 WHEN c >= 0 AND len(near) = 2 THEN abs(((c - near[2] + 450) % 180 - 90) + ((near[1] - c + 450) % 180 - 90)) / 2 ELSE -1 END, 3) + 0 AS curvature FROM l""")
def measurement_views(spark, sf):
    """The four views of an edge detection: measure, thin measure (null off the medial axis), direction, and
    curvature of the directions on the thin edges."""

    def work(image_id, pdf):
        score, turn = sh.edges(one.grid(pdf))
        score, angle = np.round(score, 4) + 0.0, np.round(sh.degrees(turn), 2) + 0.0
        kept = thins.medial_axis(score > 0)
        curved = np.round(sh.bend(np.where(kept, angle, np.nan)), 3) + 0.0
        return _rows(image_id, _rounded(score, 4), _rounded(np.where(kept, score, np.nan), 4), _rounded(angle, 2), _rounded(curved, 3), shape=score.shape)

    return one.per_image(base._u8(spark, sf), work, "image_id long, y int, x int, edge double, thin_edge double, orientation double, curvature double")


def _otsu_sql(source: str, name: str) -> str:
    return f"""{name}_c AS (SELECT image_id, v, CAST(sum(n) OVER up AS BIGINT) AS w0, CAST(sum(n * v) OVER up AS BIGINT) AS s0, CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS wt, CAST(sum(n * v) OVER (PARTITION BY image_id) AS BIGINT) AS st
            FROM (SELECT image_id, v, count(*) AS n FROM {source} GROUP BY 1, 2) WINDOW up AS (PARTITION BY image_id ORDER BY v)),
        {name} AS (SELECT image_id, arg_max(v, {{'b': CASE WHEN w0 * (wt - w0) > 0 THEN CAST(s0 * wt - st * w0 AS DOUBLE) * CAST(s0 * wt - st * w0 AS DOUBLE) / CAST(w0 * (wt - w0) AS DOUBLE) ELSE 0.0 END, 'v': -v}}) AS threshold FROM {name}_c GROUP BY 1)"""


_THREE = f"""{_BYTES}, {_otsu_sql('bytes', 'cut_s')}, {base._SCALED.removeprefix(sql.U8).lstrip(' ,')}, {_otsu_sql('u8b', 'cut_g')}, {sql.canny(50, 150).removeprefix(sql.SOBEL).lstrip(' ,').replace('mag AS', 'cmag AS').replace('FROM mag', 'FROM cmag')},
    grow AS (SELECT image_id, y, x FROM flags WHERE flag = 2 UNION SELECT f.image_id, f.y, f.x FROM grow g JOIN flags f ON f.image_id = g.image_id AND abs(f.y - g.y) <= 1 AND abs(f.x - g.x) <= 1),
    judged AS (SELECT 'canny' AS filter, p.image_id, CASE WHEN g.x IS NULL THEN 0 ELSE 1 END AS hit, CASE WHEN p.v > 128 THEN 1 ELSE 0 END AS t FROM u8 p LEFT JOIN grow g ON g.image_id = p.image_id AND g.y = p.y AND g.x = p.x
        UNION ALL SELECT 'sobel', p.image_id, CASE WHEN p.v > threshold THEN 1 ELSE 0 END, CASE WHEN u8.v > 128 THEN 1 ELSE 0 END FROM u8b p JOIN cut_g USING (image_id) JOIN u8 ON u8.image_id = p.image_id AND u8.y = p.y AND u8.x = p.x
        UNION ALL SELECT 'shearlet', p.image_id, CASE WHEN p.v > threshold THEN 1 ELSE 0 END, CASE WHEN u8.v > 128 THEN 1 ELSE 0 END FROM bytes p JOIN cut_s USING (image_id) JOIN u8 ON u8.image_id = p.image_id AND u8.y = p.y AND u8.x = p.x),
    k AS (SELECT filter, image_id, {base._RATES} FROM judged GROUP BY 1, 2)"""


@plan(f"WITH RECURSIVE {_THREE} SELECT *, {base._JUDGED} FROM k")
def filter_comparison(spark, sf):
    """Precision and recall of Canny, Sobel with Otsu, and shearlets with Otsu, against the truth mask."""
    px = base._u8(spark, sf)
    truth = px.select(*KEY, (F.col("v") > 128).cast("int").alias("t"))

    def cut(found: DataFrame) -> DataFrame:
        return found.join(ops.histogram_otsu(found), "image_id").select(*KEY, (F.col("v") > F.col("threshold")).cast("int").alias("hit"))

    canny = on_grid(px, base.canny_edges(spark, sf)).select(*KEY, F.col("v").alias("hit"))
    found = {"canny": canny, "sobel": cut(base._max_scaled(spark, sf)), "shearlet": cut(edge_bytes(spark, sf))}
    parts = [base._judged(f, truth).select(F.lit(k).alias("filter"), "*") for k, f in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

