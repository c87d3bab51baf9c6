"""Pieces of the oracle SQL (DuckDB)."""

PX = "px AS (SELECT vec_id // 64 AS image_id, CAST(vec_id % 64 AS INTEGER) AS y, CAST(t.x AS INTEGER) AS x, CAST(embedding[t.x + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(x))"
U8 = (
    PX
    + ", u8 AS (SELECT image_id, y, x, CAST(CASE WHEN hi > lo THEN floor((v - lo) * 255 / (hi - lo) + 0.5) ELSE 0 END AS INTEGER) AS v "
    + "FROM (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM px))"
)
OTSU = (
    U8
    + """, hist AS (SELECT image_id, v, count(*) AS n FROM u8 GROUP BY 1, 2),
    cum AS (SELECT image_id, v, CAST(sum(n) OVER up AS BIGINT) AS w0, CAST(sum(n * v) OVER up AS BIGINT) AS s0,
                   CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS wt, CAST(sum(n * v) OVER (PARTITION BY image_id) AS BIGINT) AS st
            FROM hist WINDOW up AS (PARTITION BY image_id ORDER BY v)),
    var AS (SELECT image_id, v, CASE WHEN w0 * (wt - w0) > 0 THEN CAST(s0 * wt - st * w0 AS DOUBLE) * CAST(s0 * wt - st * w0 AS DOUBLE) / CAST(w0 * (wt - w0) AS DOUBLE) ELSE 0.0 END AS b FROM cum),
    otsu AS (SELECT image_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY b DESC, v) AS k FROM var) WHERE k = 1)"""
)
BIN = U8 + ", bin AS (SELECT image_id, y, x, CASE WHEN v > 150 THEN 1 ELSE 0 END AS v FROM u8)"


def nine(source: str, name: str, border: str = "reflect", value: str = "v", keep: str = "") -> str:
    """CTEs that give the rows of source with their eight neighbours and c."""

    def out(fn: str, other: str, col: str, window: str) -> str:
        near, far = f"{fn}({col}) OVER {window}", f"{other}({col}) OVER {window}"
        return {"zero": f"coalesce({near}, 0)", "replicate": f"coalesce({near}, {col})", "reflect": f"coalesce({near}, {far}, {col})", "none": near}[border]

    return f"""{name}_h AS (SELECT *, {value} AS c, {out("lag", "lead", value, "r")} AS w, {out("lead", "lag", value, "r")} AS e FROM {source} WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
    {name} AS (SELECT *, {out("lag", "lead", "w", "q")} AS nw, {out("lag", "lead", "c", "q")} AS n, {out("lag", "lead", "e", "q")} AS ne,
        {out("lead", "lag", "w", "q")} AS sw, {out("lead", "lag", "c", "q")} AS s, {out("lead", "lag", "e", "q")} AS se
        FROM {name}_h WINDOW q AS (PARTITION BY image_id, x ORDER BY y))"""


SOBEL = U8 + ", " + nine("u8", "n9") + ", sob AS (SELECT image_id, y, x, c AS v, ne + 2 * e + se - nw - 2 * w - sw AS gx, sw + 2 * s + se - nw - 2 * n - ne AS gy FROM n9)"
EDGES = (
    "pt AS (SELECT user_id AS edge_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i, "
    "CAST(floor((epoch(ts) - 1704067200) / 3600) AS INTEGER) AS r, CAST(floor(value) AS INTEGER) AS c FROM events)"
)
ENDS = (
    EDGES
    + ", lim AS (SELECT edge_id, max(i) AS last FROM pt GROUP BY 1), ends AS (SELECT edge_id, 0 AS \"end\", CAST(floor(r / 24) AS INTEGER) AS r, CAST(floor(c / 24) AS INTEGER) AS c FROM pt WHERE i = 0 "
    + "UNION ALL SELECT pt.edge_id, 1, CAST(floor(r / 24) AS INTEGER), CAST(floor(c / 24) AS INTEGER) FROM pt JOIN lim ON pt.edge_id = lim.edge_id AND pt.i = lim.last)"
)


def canny(low: int, high: int) -> str:
    return (
        SOBEL
        + ", mag AS (SELECT *, abs(gx) + abs(gy) AS m FROM sob), "
        + nine("mag", "m9", "zero", "m")
        + f""", nb AS (SELECT image_id, y, x, m,
        CASE WHEN abs(gy) < abs(gx) * 0.41421356237309503::DOUBLE THEN w WHEN abs(gy) > abs(gx) * 2.414213562373095::DOUBLE THEN n WHEN (gx >= 0) = (gy >= 0) THEN nw ELSE ne END AS a,
        CASE WHEN abs(gy) < abs(gx) * 0.41421356237309503::DOUBLE THEN e WHEN abs(gy) > abs(gx) * 2.414213562373095::DOUBLE THEN s WHEN (gx >= 0) = (gy >= 0) THEN se ELSE sw END AS b FROM m9),
        flags AS (SELECT image_id, y, x, CASE WHEN m > {high} THEN 2 ELSE 1 END AS flag FROM nb WHERE m > a AND m >= b AND m > {low})"""
    )


RING = "nw + n + ne + w + e + sw + s + se"
TURNS = " + ".join(f"CASE WHEN {a} < {b} THEN 1 ELSE 0 END" for a, b in (("n", "ne"), ("ne", "e"), ("e", "se"), ("se", "s"), ("s", "sw"), ("sw", "w"), ("w", "nw"), ("nw", "n")))


def fixpoint(source: str, name: str, first: str, second: str) -> str:
    """name: source (image_id, y, x, v) after passes that clear the pixels where first, then second, holds, until an
    image stays as it is.  A recursive CTE; its last rows are those with NOT more."""

    def cleared(of: str, to: str, rule: str) -> str:
        return f"{nine(of, to + '9', 'zero')}, {to} AS (SELECT image_id, y, x, was, k, CASE WHEN c = 1 AND {rule} THEN 0 ELSE c END AS v FROM {to}9)"

    return f"""{name}_r AS (SELECT image_id, y, x, v, 0 AS k, true AS more FROM {source}
        UNION ALL SELECT image_id, y, x, v, k + 1, bool_or(v <> was) OVER (PARTITION BY image_id) FROM
        (WITH live AS (SELECT image_id, y, x, v, v AS was, k FROM {name}_r WHERE more), {cleared("live", "a1", first)}, {cleared("a1", "a2", second)} SELECT * FROM a2)),
        {name} AS (SELECT image_id, y, x, v FROM {name}_r WHERE NOT more)"""


def skeleton(source: str, name: str) -> str:
    both = f"{RING} BETWEEN 2 AND 6 AND {TURNS} = 1"
    return fixpoint(source, name, f"{both} AND n * e * s = 0 AND e * s * w = 0", f"{both} AND n * e * w = 0 AND n * s * w = 0")


def thin(source: str, name: str) -> str:
    any_ = lambda *k: f"greatest({', '.join(k)})"
    turns = " + ".join(f"(1 - {a}) * {any_(b, c)}" for a, b, c in (("n", "ne", "e"), ("e", "se", "s"), ("s", "sw", "w"), ("w", "nw", "n")))
    pairs = [" + ".join(any_(a, b) for a, b in p) for p in ((("nw", "n"), ("ne", "e"), ("se", "s"), ("sw", "w")), (("n", "ne"), ("e", "se"), ("s", "sw"), ("w", "nw")))]
    both = f"{turns} = 1 AND least({pairs[0]}, {pairs[1]}) BETWEEN 2 AND 3"
    return fixpoint(source, name, f"{both} AND {any_('s', 'sw', '1 - nw')} * w = 0", f"{both} AND {any_('n', 'ne', '1 - se')} * e = 0")


def medial(source: str, name: str) -> str:
    """Distances by peeling, then one visit a pixel; images are bit strings with a frame of zeros."""
    ring = {k: f"get_bit(s.b, CAST(o.at + ({dy}) * o.w + ({dx}) AS INTEGER))" for k, (dy, dx) in {"n": (-1, 0), "ne": (-1, 1), "e": (0, 1), "se": (1, 1), "s": (1, 0), "sw": (1, -1), "w": (0, -1), "nw": (-1, -1)}.items()}
    turns = " + ".join(f"(1 - {ring[a]}) * greatest({ring[b]}, {ring[c]})" for a, b, c in (("n", "ne", "e"), ("e", "se", "s"), ("s", "sw", "w"), ("w", "nw", "n")))
    return f"""peel AS (SELECT image_id, y, x, v, 1 AS d FROM {source} UNION ALL SELECT image_id, y, x, v, d FROM
            (WITH now AS (SELECT image_id, y, x, v, d FROM peel WHERE EXISTS (SELECT 1 FROM peel WHERE v = 1)), {nine("now", "p9", "zero")}
             SELECT image_id, y, x, CASE WHEN c = 1 AND {RING} = 8 THEN 1 ELSE 0 END AS v, d + 1 AS d FROM p9)),
        far AS (SELECT image_id, y, x, CAST(sum(v) AS INTEGER) AS d FROM peel GROUP BY ALL),
        frame AS (SELECT image_id, max(x) + 3 AS w, max(y) + 3 AS h FROM {source} GROUP BY 1),
        visit AS MATERIALIZED (SELECT f.image_id, w, (y + 1) * w + x + 1 AS at, row_number() OVER (PARTITION BY f.image_id ORDER BY d, y, x) AS k FROM far f JOIN frame z USING (image_id) WHERE d > 0),
        start AS (SELECT z.image_id, CAST(string_agg(CAST(coalesce(p.v, 0) AS VARCHAR), '' ORDER BY t.i) AS BIT) AS b FROM frame z, range(70 * 70) t(i) LEFT JOIN {source} p
            ON p.image_id = z.image_id AND p.y = t.i // z.w - 1 AND p.x = t.i % z.w - 1 WHERE t.i < z.w * z.h GROUP BY 1),
        walk AS (SELECT image_id, b, CAST(0 AS BIGINT) AS k FROM start UNION ALL
            SELECT s.image_id, CASE WHEN {turns} = 1 AND {" + ".join(ring.values())} >= 2 THEN set_bit(s.b, CAST(o.at AS INTEGER), 0) ELSE s.b END, o.k
            FROM walk s JOIN visit o ON o.image_id = s.image_id AND o.k = s.k + 1),
        {name} AS (SELECT p.image_id, p.y, p.x, get_bit(s.b, CAST((p.y + 1) * z.w + p.x + 1 AS INTEGER)) AS v FROM {source} p JOIN frame z USING (image_id)
            JOIN (SELECT image_id, arg_max(b, k) AS b FROM walk GROUP BY 1) s USING (image_id))"""
