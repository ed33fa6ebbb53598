"""DuckDB oracle SQL for the chart-data queries (events table, and the
dirty_lineitem frame for the correlation matrix)."""

from __future__ import annotations

from tabsmith.plans.sql_fixtures import DIRTY_COLUMNS, DIRTY_LINEITEM, lit, qi, r4, union_all

EVENT_NUMERIC = [(1, "event_id"), (3, "user_id"), (5, "value")]


def _long(cols, table="events", hue=None):
    h = f", {qi(hue)}::VARCHAR AS g" if hue else ", NULL::VARCHAR AS g"
    return union_all([f"SELECT {o}::BIGINT AS ordinal, {lit(c)} AS \"column\", {qi(c)}::DOUBLE AS x{h} "
                      f"FROM {table}" for o, c in cols])


def correlation_matrix() -> str:
    nums = [c for c, _, k in DIRTY_COLUMNS if k == "numeric"]
    sel = []
    for a, x in enumerate(nums):
        d = f"CASE WHEN stddev_samp({qi(x)}::DOUBLE) > 0 THEN 1.0::DOUBLE END"
        sel.append(f"SELECT {a + 1}::BIGINT AS i, {a + 1}::BIGINT AS j, {lit(x)} AS col_x, "
                   f"{lit(x)} AS col_y, {d} AS r FROM dirty")
        for b in range(a + 1, len(nums)):
            y = nums[b]
            r = f"corr({qi(x)}::DOUBLE, {qi(y)}::DOUBLE)"
            r = f"CASE WHEN isnan({r}) THEN NULL ELSE {r} END"
            sel.append(f"SELECT {a + 1}::BIGINT AS i, {b + 1}::BIGINT AS j, {lit(x)} AS col_x, "
                       f"{lit(y)} AS col_y, {r} AS r FROM dirty")
            sel.append(f"SELECT {b + 1}::BIGINT AS i, {a + 1}::BIGINT AS j, {lit(y)} AS col_x, "
                       f"{lit(x)} AS col_y, {r} AS r FROM dirty")
    return (f"WITH {DIRTY_LINEITEM},\ncells AS ({union_all(sel)})\n"
            f"SELECT i, j, col_x, col_y, {r4('r')} AS r FROM cells")


def _hist_tail(nb_expr: str) -> str:
    """Grid of bins per column from ``p0`` (ordinal, column, lo0, hi0, nb),
    values binned by counting interior edges <= x."""
    return f"""
p AS (SELECT ordinal, "column", {nb_expr} AS nb,
        CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
        CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM p0),
ks AS (SELECT ordinal, "column", nb, lo, hi, unnest(range(nb)) AS k FROM p),
grid AS (SELECT ordinal, "column", k + 1 AS bin,
        k * ((hi - lo) / nb) + lo AS blo,
        CASE WHEN k = nb - 1 THEN hi ELSE (k + 1) * ((hi - lo) / nb) + lo END AS bhi FROM ks),
vals AS (SELECT ordinal, x, count(*) AS c FROM long WHERE x IS NOT NULL GROUP BY ordinal, x),
vb AS (SELECT v.ordinal, v.c, 1 + (SELECT count(*) FROM grid g
         WHERE g.ordinal = v.ordinal AND g.bin > 1 AND v.x >= g.blo) AS bin FROM vals v),
counts AS (SELECT ordinal, bin, sum(c) AS n FROM vb GROUP BY ordinal, bin)
SELECT g.ordinal::BIGINT AS ordinal, g."column", g.bin::BIGINT AS bin, {r4('g.blo')} AS lo,
       {r4('g.bhi')} AS hi, coalesce(c.n, 0)::BIGINT AS n
FROM grid g LEFT JOIN counts c ON c.ordinal = g.ordinal AND c.bin = g.bin"""


def histogram(bins: int = 20) -> str:
    return (f"WITH long AS ({_long(EVENT_NUMERIC)}),\n"
            f"p0 AS (SELECT ordinal, \"column\", min(x) AS lo0, max(x) AS hi0 FROM long "
            f"WHERE x IS NOT NULL GROUP BY ordinal, \"column\"),"
            + _hist_tail(f"{bins}::BIGINT"))


def distributions() -> str:
    return (f"WITH long AS ({_long(EVENT_NUMERIC)}),\n"
            f"s AS (SELECT ordinal, \"column\", count(x) AS n, min(x) AS lo0, max(x) AS hi0, "
            f"quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM long "
            f"WHERE x IS NOT NULL GROUP BY ordinal, \"column\"),\n"
            f"w AS (SELECT *, (hi0 - lo0) / (log2(n) + 1.0) AS sturges, "
            f"2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM s),\n"
            f"p0 AS (SELECT *, CASE WHEN fd <> 0 THEN least(fd, sturges) ELSE sturges END AS width "
            f"FROM w),"
            + _hist_tail("CASE WHEN width <> 0 THEN ceil((hi0 - lo0) / width)::BIGINT ELSE 1 END"))


def _kde(points: int, base: str, cols, hue) -> str:
    grp = "g" if hue else "NULL::VARCHAR"
    return f"""WITH base AS ({base}),
long AS ({_long(cols, "base", hue)}),
p AS (SELECT "column", g, count(x) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi
      FROM long WHERE x IS NOT NULL GROUP BY "column", g HAVING stddev_samp(x) > 0),
q AS (SELECT *, sd * pow(n, -1.0 / 5.0) AS h, (hi - lo) / {points - 1} AS step FROM p),
grid AS (SELECT "column", g, n, h, k + 1 AS point,
         CASE WHEN k = {points - 1} THEN hi ELSE k * step + lo END AS gx
         FROM q, range({points}) t(k))
SELECT gr."column", {'gr.g' if hue else grp} AS "group", gr.point::BIGINT AS point,
       {r4('gr.gx')} AS x,
       round_even(sum(exp(-0.5 * ((l.x - gr.gx) / gr.h) * ((l.x - gr.gx) / gr.h)))
                  / (gr.n * gr.h * sqrt(2 * pi())), 8) AS density
FROM grid gr JOIN long l ON l."column" = gr."column" AND l.x IS NOT NULL
     AND {'l.g = gr.g' if hue else 'TRUE'}
GROUP BY gr."column", gr.g, gr.point, gr.gx, gr.n, gr.h"""


def kde(points: int = 50) -> str:
    return _kde(points, "SELECT * FROM events", EVENT_NUMERIC, None)


PAIR_BASE = ("SELECT event_id, user_id, value, event_type FROM events WHERE event_id IS NOT NULL "
             "AND user_id IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL")


def pair_grid_diagonal(points: int = 50) -> str:
    return _kde(points, PAIR_BASE, EVENT_NUMERIC, "event_type")


def violin_density(points: int = 100) -> str:
    return _kde(points, "SELECT * FROM events WHERE event_type IS NOT NULL", EVENT_NUMERIC,
                "event_type")


def box_stats() -> str:
    return f"""WITH long AS ({_long(EVENT_NUMERIC)}),
q AS (SELECT ordinal, "column", count(x) AS n, quantile_cont(x, 0.25) AS q1,
      quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM long
      WHERE x IS NOT NULL GROUP BY ordinal, "column"),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lov, q3 + 1.5 * (q3 - q1) AS hiv FROM q),
w AS (SELECT f.ordinal, f."column", f.n, f.q1, f.med, f.q3,
      min(l.x) FILTER (WHERE l.x >= f.lov) AS wl, max(l.x) FILTER (WHERE l.x <= f.hiv) AS wh,
      count(*) FILTER (WHERE l.x < f.lov OR l.x > f.hiv) AS fl
      FROM f JOIN long l ON l.ordinal = f.ordinal AND l.x IS NOT NULL
      GROUP BY f.ordinal, f."column", f.n, f.q1, f.med, f.q3)
SELECT ordinal, "column", n::BIGINT AS n, {r4('q1')} AS q1, {r4('med')} AS median, {r4('q3')} AS q3,
  {r4('CASE WHEN wl IS NULL OR wl > q1 THEN q1 ELSE wl END')} AS whisker_lo,
  {r4('CASE WHEN wh IS NULL OR wh < q3 THEN q3 ELSE wh END')} AS whisker_hi,
  fl::BIGINT AS fliers FROM w"""


def _bucket(x, lo, hi, bins=20):
    return (f"(CASE WHEN {hi} = {lo} THEN 0 ELSE least(floor(({x} - {lo}) / ({hi} - {lo}) "
            f"* {float(bins)}), {bins - 1}) END)::BIGINT")


def scatter(bins: int = 20) -> str:
    bx = _bucket("event_id::DOUBLE", "xlo", "xhi", bins)
    by = _bucket("user_id::DOUBLE", "ylo", "yhi", bins)
    return f"""WITH b AS (SELECT * FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL
                AND event_type IS NOT NULL),
st AS (SELECT min(event_id::DOUBLE) AS xlo, max(event_id::DOUBLE) AS xhi,
              min(user_id::DOUBLE) AS ylo, max(user_id::DOUBLE) AS yhi FROM b),
c AS (SELECT event_type AS hue, {bx} AS bx, {by} AS "by", xlo, xhi, ylo, yhi FROM b, st)
SELECT hue, bx, "by", {r4(f'bx * ((xhi - xlo) / {bins}) + xlo')} AS x_lo,
       {r4(f'bx * ((xhi - xlo) / {bins}) + xlo + ((xhi - xlo) / {bins})')} AS x_hi,
       {r4(f'"by" * ((yhi - ylo) / {bins}) + ylo')} AS y_lo,
       {r4(f'"by" * ((yhi - ylo) / {bins}) + ylo + ((yhi - ylo) / {bins})')} AS y_hi,
       count(*)::BIGINT AS n
FROM c GROUP BY hue, bx, "by", xlo, xhi, ylo, yhi"""


def pair_grid(bins: int = 20) -> str:
    names = ["event_id", "user_id", "value"]
    st = ", ".join(f"min({n}::DOUBLE) AS lo_{n}, max({n}::DOUBLE) AS hi_{n}" for n in names)
    sel = []
    for a in range(3):
        for b in range(a + 1, 3):
            x, y = names[a], names[b]
            sel.append(f"SELECT {a + 1}::BIGINT AS i, {b + 1}::BIGINT AS j, {lit(x)} AS col_x, "
                       f"{lit(y)} AS col_y, event_type AS hue, "
                       f"{_bucket(x + '::DOUBLE', 'lo_' + x, 'hi_' + x, bins)} AS bx, "
                       f"{_bucket(y + '::DOUBLE', 'lo_' + y, 'hi_' + y, bins)} AS \"by\" FROM base, st")
    return (f"WITH base AS ({PAIR_BASE}),\nst AS (SELECT {st} FROM base),\n"
            f"cells AS ({union_all(sel)})\n"
            f"SELECT i, j, col_x, col_y, hue, bx, \"by\", count(*)::BIGINT AS n FROM cells "
            f"GROUP BY i, j, col_x, col_y, hue, bx, \"by\"")


def violin() -> str:
    return (f"WITH long AS ({_long(EVENT_NUMERIC, hue='event_type')})\n"
            f"SELECT \"column\", g AS \"group\", count(x)::BIGINT AS n, {r4('min(x)')} AS min, "
            f"{r4('quantile_cont(x, 0.5)')} AS median, {r4('max(x)')} AS max FROM long "
            f"WHERE g IS NOT NULL AND x IS NOT NULL GROUP BY \"column\", g")


def group_by_category() -> str:
    return ("SELECT event_type AS \"group\", count(*)::BIGINT AS n FROM events "
            "WHERE event_type IS NOT NULL GROUP BY event_type")


def bar_counts(k: int = 10) -> str:
    return (f"WITH c AS (SELECT event_type AS value, count(*) AS cnt FROM events "
            f"WHERE event_type IS NOT NULL GROUP BY event_type),\n"
            f"r AS (SELECT row_number() OVER (ORDER BY cnt DESC, value) AS rank, value, cnt FROM c)\n"
            f"SELECT rank::BIGINT AS rank, value, cnt::BIGINT AS count FROM r WHERE rank <= {k}")


def line_series() -> str:
    return (f"SELECT date_trunc('day', ts)::TIMESTAMP AS period, {r4('avg(value)')} AS mean, "
            f"count(value)::BIGINT AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")


def trend() -> str:
    x = "(epoch_us(ts)::DOUBLE / 86400000000.0)"
    return (f"SELECT regr_count(value, {x})::BIGINT AS n, {r4(f'regr_slope(value, {x})')} AS slope_per_day, "
            f"{r4(f'regr_intercept(value, {x})')} AS intercept, {r4(f'regr_r2(value, {x})')} AS r2 "
            f"FROM events")


def charts_sql() -> dict[str, str]:
    return {
        "correlation_matrix": correlation_matrix(),
        "histogram": histogram(),
        "distributions": distributions(),
        "kde": kde(),
        "box_stats": box_stats(),
        "scatter": scatter(),
        "pair_grid": pair_grid(),
        "pair_grid_diagonal": pair_grid_diagonal(),
        "violin": violin(),
        "violin_density": violin_density(),
        "group_by_category": group_by_category(),
        "bar_counts": bar_counts(),
        "line_series": line_series(),
        "trend": trend(),
    }
