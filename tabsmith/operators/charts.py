"""Chart data (VZ1-VZ10, VZ-K, AN6): the numbers behind each chart, reduced on
the cluster so the result size depends on bins / grid points / groups, never
on the number of input rows. Drawing is out of scope.

Common shape: one aggregate for ranges (min, max, count, std), then one pass
that maps every value to a bucket or grid contribution and aggregates with
map-side partial aggregation. Per-column parameters travel as literals, or,
when they vary per group, as a small size-checked broadcast table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import (CATEGORICAL, NUMERIC, as_double, col, columns_info,
                                        rows_from_structs)
from tabsmith.functions.quantiles import (BROADCAST_MAX, column_stats, grouped_quantiles_frame,
                                          long_values, quantiles)
from tabsmith.operators.profile import correlation_all
from tabsmith.session import materialize


def _numeric(df: DataFrame, columns: list[str] | None = None) -> list[tuple[int, str]]:
    return [(c.ordinal, c.name) for c in columns_info(df)
            if c.cls == NUMERIC and (columns is None or c.name in columns)]


def first_categorical(df: DataFrame) -> str | None:
    cats = [c.name for c in columns_info(df) if c.cls == CATEGORICAL]
    return cats[0] if cats else None


# ------------------------------------------------------------ correlation

def correlation_matrix(df: DataFrame) -> DataFrame:
    """VZ1: signed Pearson matrix incl. the diagonal (1.0, NULL when constant),
    pairwise deletion; the pairs of AN4, mirrored, from the same one pass."""
    names, r = correlation_all(df)
    rows = [(i + 1, j + 1, names[i], names[j], v) for (i, j), v in r.items()]
    rows += [(j, i, b, a, v) for i, j, a, b, v in rows if i < j]
    return df.sparkSession.createDataFrame(rows, "i bigint, j bigint, col_x string, col_y string, r double")


# -------------------------------------------------------------- histogram

def bin_edges(lo: float, hi: float, bins: int) -> list[float]:
    """numpy's equal-width edges: linspace(lo, hi, bins + 1); a constant
    range becomes (lo - 0.5, hi + 0.5). Like numpy, an infinite range is an
    error."""
    if not (math.isfinite(lo) and math.isfinite(hi)):
        raise ValueError(f"autodetected range of [{lo}, {hi}] is not finite")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    return [k * step + lo for k in range(bins)] + [hi]


def bin_index(x: Column, edges: list[float]) -> Column:
    """0-based bin with edges[k] <= x < edges[k+1], the last bin closed.

    A floor estimate plus a one-step correction against the exact edges (the
    rule numpy applies), all codegen-friendly expressions.
    """
    bins = len(edges) - 1
    lo, hi = edges[0], edges[-1]
    est = F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))),
                             F.lit(0)), F.lit(bins - 1)).cast("int")
    arr = F.array(*[F.lit(e) for e in edges])
    lower = F.element_at(arr, est + 1)
    upper = F.element_at(arr, est + 2)
    return (F.when(x < lower, est - 1)
             .when((x >= upper) & (est != F.lit(bins - 1)), est + 1)
             .otherwise(est))


def _histograms(df: DataFrame, specs: list[tuple[int, str, list[float]]]) -> DataFrame:
    """(ordinal, column, bin 1-based, lo, hi, n) for each (ordinal, name, edges),
    empty bins included. One pass, pre-aggregated per (column, bin)."""
    spark = df.sparkSession
    grid = [(o, n, k + 1, e[k], e[k + 1]) for o, n, e in specs for k in range(len(e) - 1)]
    grid_df = spark.createDataFrame(
        grid, "ordinal bigint, column string, bin bigint, lo double, hi double")
    if not specs:
        return grid_df.withColumn("n", F.lit(0).cast("bigint"))
    items = F.array(*[
        F.when(as_double(n).isNotNull(),
               F.struct(F.lit(o).cast("bigint").alias("ordinal"),
                        (bin_index(as_double(n), e) + 1).cast("bigint").alias("bin")))
        for o, n, e in specs])
    counts = (df.select(F.explode(F.array_compact(items)).alias("s")).select("s.*")
                .groupBy("ordinal", "bin").agg(F.count(F.lit(1)).alias("n")))
    return (grid_df.join(counts, ["ordinal", "bin"], "left")
                   .select("ordinal", "column", "bin", "lo", "hi",
                           F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def histogram(df: DataFrame, bins: int = 20, columns: list[str] | None = None) -> DataFrame:
    """VZ6: ``bins`` equal-width bins per numeric column over [min, max]."""
    cols = _numeric(df, columns)
    st = column_stats(df, [n for _, n in cols])
    specs = [(o, n, bin_edges(st[n][1], st[n][2], bins)) for o, n in cols if st[n][0]]
    return _histograms(df, specs)


def auto_bin_count(n: int, lo: float, hi: float, q25: float, q75: float) -> int:
    """numpy's ``bins="auto"``: the smaller of the Freedman-Diaconis and Sturges
    widths (Sturges alone when the IQR is 0)."""
    ptp = hi - lo
    sturges = ptp / (math.log2(n) + 1.0)
    fd = 2.0 * (q75 - q25) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd else sturges
    if not width:
        return 1
    return int(math.ceil(ptp / width))


def distributions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """VZ2 (histogram part): every numeric column binned with the automatic
    bin count; the KDE curve is ``kde``."""
    cols = _numeric(df, columns)
    names = [n for _, n in cols]
    st = column_stats(df, names)
    live = [n for n in names if st[n][0]]
    qs = quantiles(df, live, [0.25, 0.75], st)
    specs = []
    for o, n in cols:
        if n not in live:
            continue
        cnt, lo, hi = st[n]
        b = auto_bin_count(cnt, lo, hi, qs[(n, 0.25)], qs[(n, 0.75)])
        specs.append((o, n, bin_edges(lo, hi, b)))
    return _histograms(df, specs)


# -------------------------------------------------------------------- KDE

#: A cell of the fast Gauss transform is this part of a bandwidth wide, and keeps so many moments.
#: With |u| <= CELL / 2 the terms left out of exp(t u - u^2 / 2) = sum of He_j(t) u^j / j! are, times
#: exp(-t^2 / 2), at most 1.09 sum over j >= MOMENTS of |u|^j / sqrt(j!) (Cramer's bound): 6e-13 of a kernel's peak.
CELL, MOMENTS = 0.25, 10


def hermite(j: int) -> list[int]:
    """Coefficients of the probabilists' Hermite polynomial He_j, constant first."""
    before, now = [0], [1]
    for k in range(j):
        up = [0] + now
        before, now = now, [c - k * (before[i] if i < len(before) else 0) for i, c in enumerate(up)]
    return now


def _cells(values: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the values in each cell of their series, and the cell's centre; one row a cell in use."""
    width = F.col("h") * F.lit(CELL)
    j = values.withColumn("cell", F.floor((F.col("x") - F.col("lo")) / width))
    j = j.withColumn("centre", F.col("lo") + (F.col("cell").cast("double") + 0.5) * width)
    j = j.withColumn("u", (F.col("x") - F.col("centre")) / F.col("h"))
    u, power = F.col("u"), F.lit(1.0)
    sums = []
    for m in range(MOMENTS):
        sums.append(F.sum(power).alias(f"m{m}"))
        power = u if m == 0 else power * u
    return j.groupBy(*keys, "cell", "centre").agg(*sums)


def kde(df: DataFrame, columns: list[str] | None = None, points: int = 50, by: str | None = None) -> DataFrame:
    """VZ-K: Gaussian KDE with Scott's bandwidth (h = std * n^(-1/5)) on
    ``points`` grid points from min to max, per column (and per group of
    ``by``). Output (column, group, point, x, density).

    A fast Gauss transform: one pass sums MOMENTS powers of the values in cells
    of a quarter bandwidth (pre-aggregated before the shuffle, so a hot group
    costs its cells), and the grid is summed over cells by a truncated Hermite
    series, within 1e-12 of a kernel's peak of the plain sum. No term grows with
    values times points. The values join a small parameter table (one row per
    column and group, broadcast below a checked size).
    """
    names = [n for _, n in _numeric(df, columns)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, group string, point bigint, x double, density double")
    long = long_values(df, names, by)
    # one row a series, kept as a table however many series there are; scipy
    # cannot form a KDE of fewer than two distinct values
    params = materialize(
        long.groupBy("g", "cid")
            .agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
                 F.min("x").alias("lo"), F.max("x").alias("hi"))
            .filter(F.col("sd").isNotNull() & (F.col("sd") != 0))
            .select("g", "cid", "n", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"), "lo", "hi",
                    ((F.col("hi") - F.col("lo")) / (points - 1) if points > 1 else F.lit(0.0)).alias("step")))
    j = long.join(F.broadcast(params) if params.count() <= BROADCAST_MAX else params, ["g", "cid"])
    series = ["g", "cid", "n", "h", "lo", "hi", "step"]
    cells = _cells(j, series)
    # the series in powers of t: c_i = sum over j of m_j / j! times the i-th coefficient of He_j
    coefficients = []
    for i in range(MOMENTS):
        terms = [F.col(f"m{m}") * F.lit(hermite(m)[i] / math.factorial(m)) for m in range(i, MOMENTS) if hermite(m)[i]]
        coefficients.append(reduce(lambda a, b: a + b, terms).alias(f"c{i}"))
    grid = cells.select(*series, "centre", *coefficients, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    x = F.when(F.col("k") == points - 1, F.col("hi")).otherwise(F.col("k").cast("double") * F.col("step") + F.col("lo"))
    grid = grid.withColumn("at", x).withColumn("t", (F.col("at") - F.col("centre")) / F.col("h"))
    t = F.col("t")
    series_at = F.col(f"c{MOMENTS - 1}")
    for i in range(MOMENTS - 2, -1, -1):
        series_at = series_at * t + F.col(f"c{i}")
    sums = grid.groupBy(*series, "k", "at").agg(F.sum(F.exp(F.lit(-0.5) * t * t) * series_at).alias("s"))
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi))
    return sums.select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("cid") + 1).alias("column"),
        (F.col("g") if by else F.lit(None).cast("string")).alias("group"),
        (F.col("k") + 1).cast("bigint").alias("point"), F.col("at").alias("x"), (F.col("s") / norm).alias("density"))


# ------------------------------------------------------------------- box

def box_stats(df: DataFrame, columns: list[str] | None = None, whis: float = 1.5) -> DataFrame:
    """VZ4: quartiles, whiskers at the furthest datum within ``whis`` * IQR of
    the box, and the number of fliers beyond them (matplotlib's rule)."""
    spark = df.sparkSession
    cols = _numeric(df, columns)
    names = [n for _, n in cols]
    st = column_stats(df, names)
    live = [n for n in names if st[n][0]]
    qs = quantiles(df, live, [0.25, 0.5, 0.75], st)
    fences = {}
    aggs = []
    for i, n in enumerate(live):
        q1, q3 = qs[(n, 0.25)], qs[(n, 0.75)]
        iqr = q3 - q1
        lo, hi = q1 - whis * iqr, q3 + whis * iqr
        fences[n] = (lo, hi)
        x = as_double(n)
        aggs += [F.min(F.when(x >= F.lit(lo), x)).alias(f"wl{i}"),
                 F.max(F.when(x <= F.lit(hi), x)).alias(f"wh{i}"),
                 F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"f{i}")]
    row = df.agg(*aggs).collect()[0] if aggs else None
    out = []
    for o, n in cols:
        if n not in live:
            continue
        i = live.index(n)
        q1, med, q3 = qs[(n, 0.25)], qs[(n, 0.5)], qs[(n, 0.75)]
        wl, wh = row[f"wl{i}"], row[f"wh{i}"]
        wl = q1 if wl is None or wl > q1 else wl
        wh = q3 if wh is None or wh < q3 else wh
        out.append((o, n, st[n][0], q1, med, q3, wl, wh, row[f"f{i}"]))
    return spark.createDataFrame(out, "ordinal bigint, column string, n bigint, q1 double, "
                                      "median double, q3 double, whisker_lo double, "
                                      "whisker_hi double, fliers bigint")


# ---------------------------------------------------------- 2-D binning

def _bucket(x: Column, lo: float, hi: float, bins: int) -> Column:
    if hi == lo:
        return F.lit(0).cast("bigint")
    return F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))),
                   F.lit(bins - 1)).cast("bigint")


def scatter(df: DataFrame, bins: int = 20) -> DataFrame:
    """VZ5: first two numeric columns, coloured by the first categorical;
    rows with a missing colour are dropped (``groupby`` drops NaN keys).
    Output: 2-D bin counts (hue, bx, by, x_lo, x_hi, y_lo, y_hi, n)."""
    cols = _numeric(df)
    if len(cols) < 2:
        raise ValueError("scatter needs at least 2 numeric columns")
    xn, yn = cols[0][1], cols[1][1]
    hue = first_categorical(df)
    base = df.filter(col(xn).isNotNull() & col(yn).isNotNull())
    if hue:
        base = base.filter(col(hue).isNotNull())
    st = column_stats(base, [xn, yn])
    (_, xlo, xhi), (_, ylo, yhi) = st[xn], st[yn]
    if xlo is None:
        return df.sparkSession.createDataFrame(
            [], "hue string, bx bigint, by bigint, x_lo double, x_hi double, "
                "y_lo double, y_hi double, n bigint")
    xs, ys = (xhi - xlo) / bins, (yhi - ylo) / bins
    h = col(hue).cast("string") if hue else F.lit(None).cast("string")
    g = base.select(h.alias("hue"), _bucket(as_double(xn), xlo, xhi, bins).alias("bx"),
                    _bucket(as_double(yn), ylo, yhi, bins).alias("by"))
    return (g.groupBy("hue", "bx", "by").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
             .select("hue", "bx", "by",
                     (F.col("bx") * F.lit(xs) + F.lit(xlo)).alias("x_lo"),
                     (F.col("bx") * F.lit(xs) + F.lit(xlo) + F.lit(xs)).alias("x_hi"),
                     (F.col("by") * F.lit(ys) + F.lit(ylo)).alias("y_lo"),
                     (F.col("by") * F.lit(ys) + F.lit(ylo) + F.lit(ys)).alias("y_hi"), "n"))


def pair_grid_frame(df: DataFrame, max_cols: int = 5) -> tuple[DataFrame, list[str], str | None]:
    """VZ3 input: the first ``max_cols`` numeric columns plus the colour
    column, complete rows only (select + dropna)."""
    names = [n for _, n in _numeric(df)][:max_cols]
    hue = first_categorical(df)
    keep = names + ([hue] if hue else [])
    return df.select(*[col(n) for n in keep]).na.drop(how="any"), names, hue


def pair_grid(df: DataFrame, max_cols: int = 5, bins: int = 20) -> DataFrame:
    """VZ3: 2-D bin counts for every pair i<j of the first ``max_cols``
    numeric columns, by colour: (i, j, col_x, col_y, hue, bx, by, n).
    The diagonal KDE by colour is ``pair_grid_diagonal``."""
    base, names, hue = pair_grid_frame(df, max_cols)
    if len(names) < 2:
        raise ValueError("pair_grid needs at least 2 numeric columns")
    st = column_stats(base, names)
    h = col(hue).cast("string") if hue else F.lit(None).cast("string")
    items = []
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            xa, xb = names[a], names[b]
            items.append(F.struct(
                F.lit(a + 1).cast("bigint").alias("i"), F.lit(b + 1).cast("bigint").alias("j"),
                _bucket(as_double(xa), st[xa][1] or 0.0, st[xa][2] or 0.0, bins).alias("bx"),
                _bucket(as_double(xb), st[xb][1] or 0.0, st[xb][2] or 0.0, bins).alias("by")))
    cells = base.select(h.alias("hue"), F.inline(F.array(*items)))
    counts = cells.groupBy("i", "j", "hue", "bx", "by").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))
    name_arr = F.array(*[F.lit(n) for n in names])
    return counts.select("i", "j", F.element_at(name_arr, F.col("i").cast("int")).alias("col_x"),
                         F.element_at(name_arr, F.col("j").cast("int")).alias("col_y"),
                         "hue", "bx", "by", "n")


def pair_grid_diagonal(df: DataFrame, max_cols: int = 5, points: int = 50) -> DataFrame:
    """VZ3 diagonal: KDE of each plotted column by colour."""
    base, names, hue = pair_grid_frame(df, max_cols)
    return kde(base, names, points, by=hue)


# ---------------------------------------------------------------- groups

def group_by_category(df: DataFrame, key: str | None = None) -> DataFrame:
    """VZ8: the groups behind scatter / violin: (group, n), missing keys dropped."""
    key = key or first_categorical(df)
    if key is None:
        raise ValueError("no categorical column")
    return (df.filter(col(key).isNotNull())
              .groupBy(col(key).cast("string").alias("group"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def violin(df: DataFrame, max_cols: int = 4) -> DataFrame:
    """VZ7: per plotted column (first ``max_cols`` numeric) and group of the
    first categorical: n, min, exact median, max. Each row carries its group
    key (the reference labels groups in first-seen order but plots them
    sorted)."""
    spark = df.sparkSession
    names = [n for _, n in _numeric(df)][:max_cols]
    hue = first_categorical(df)
    schema = "column string, group string, n bigint, min double, median double, max double"
    if hue is None:
        st = column_stats(df, names)
        qs = quantiles(df, [n for n in names if st[n][0]], [0.5], st)
        rows = [(n, None, st[n][0], st[n][1], qs.get((n, 0.5)), st[n][2]) for n in names]
        return spark.createDataFrame(rows, schema)
    q = grouped_quantiles_frame(df, hue, names, [0.5])
    name_arr = F.array(*[F.lit(n) for n in names])
    return q.select(F.element_at(name_arr, F.col("cid") + 1).alias("column"),
                    F.col("g").alias("group"), F.col("n").cast("bigint").alias("n"),
                    F.col("lo").alias("min"), F.col("q0").alias("median"),
                    F.col("hi").alias("max"))


def violin_density(df: DataFrame, max_cols: int = 4, points: int = 100) -> DataFrame:
    """VZ7 shape: KDE per plotted column and group (100 grid points)."""
    names = [n for _, n in _numeric(df)][:max_cols]
    return kde(df, names, points, by=first_categorical(df))


# ----------------------------------------------------- promised charts

def bar_counts(df: DataFrame, cat: str, k: int = 10) -> DataFrame:
    """VZ9: the k most frequent values of ``cat``: (rank, value, count)."""
    counts = (df.filter(col(cat).isNotNull())
                .groupBy(col(cat).cast("string").alias("value"))
                .agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    top = counts.orderBy(F.col("count").desc(), "value").limit(k)
    from pyspark.sql import Window
    w = Window.orderBy(F.col("count").desc(), "value")  # at most k rows
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "value", "count")


def line_series(df: DataFrame, ts: str, value: str, unit: str = "day") -> DataFrame:
    """VZ10: mean and count of ``value`` per ``unit`` period of ``ts``
    (wall-clock periods for TIMESTAMP_NTZ columns, whatever the session zone)."""
    from pyspark.sql import types as T
    period = F.date_trunc(unit, col(ts))
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        period = period.cast("timestamp_ntz")
    return (df.filter(col(ts).isNotNull())
              .groupBy(period.alias("period"))
              .agg(F.avg(as_double(value)).alias("mean"),
                   F.count(col(value)).cast("bigint").alias("n")))


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970-01-01 without a time-zone shift for wall-clock
    (TIMESTAMP_NTZ) columns; instants (TIMESTAMP) use their UTC epoch."""
    from pyspark.sql import types as T
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, col(ts))
    return F.unix_micros(col(ts))


def trend(df: DataFrame, ts: str, value: str) -> DataFrame:
    """AN6: least-squares trend of ``value`` over time (per day)."""
    x = epoch_micros(df, ts).cast("double") / F.lit(86_400_000_000.0)
    y = as_double(value)
    return df.agg(F.regr_count(y, x).cast("bigint").alias("n"),
                  F.regr_slope(y, x).alias("slope_per_day"),
                  F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"))


def chart_union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
