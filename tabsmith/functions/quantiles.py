"""Exact order statistics and quantiles without gathering a column in one task.

Spark's exact ``percentile`` / ``median`` aggregate keeps a map of every
distinct value of the group in one buffer; for a global group over a large
table that buffer ends up in one task. ``percentile_approx`` is bounded but
approximate. The reference reports exact pandas quantiles, so this module finds
them by distributed selection:

1. The input is viewed in long form ``(g, cid, x)``: group key, column id,
   value. Each pending target (series, 0-based rank) owns a value range
   [lo, hi] known to hold its answer, the number of values in it and the
   rank inside it.
2. While a range holds more than ``FINAL_MAX`` values, one pass splits it
   into ``BINS`` equal-width buckets: the data joins the small range table
   on (g, cid), ``groupBy(range, bucket)`` is partially aggregated (count,
   min, max), a running count per range (a window over at most ``BINS`` rows)
   locates the rank, and the new range is that bucket's actual [min, max],
   so every pass strictly narrows it.
3. Once a range is small, ``groupBy(range, value).count()`` plus a running
   count picks the exact value.

Every shuffle is pre-aggregated, every window partition holds at most
``max(BINS, FINAL_MAX)`` rows, the driver receives one row per target, and
the range table is broadcast only below ``BROADCAST_MAX`` rows. A hot value or
a hot group collapses in the partial aggregation before any shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.columns import as_double, col

BINS = 16384
FINAL_MAX = 100_000
BROADCAST_MAX = 100_000


@dataclass
class _Target:
    g: str
    cid: int
    rank: int          # 0-based rank inside [lo, hi]
    lo: float
    hi: float
    n_in: int
    value: float | None = None
    done: bool = False


def long_values(df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """(g string, cid int, x double) for the non-NULL values of ``columns``."""
    items = F.array(*[F.struct(F.lit(i).alias("cid"), as_double(c).alias("x"))
                      for i, c in enumerate(columns)])
    g = col(group).cast("string") if group else F.lit("")
    base = df.filter(col(group).isNotNull()) if group else df
    return base.select(g.alias("g"), F.inline(items)).filter(F.col("x").isNotNull())


def _ranges(targets: list[_Target]) -> dict:
    ranges: dict[tuple, int] = {}
    for t in targets:
        ranges.setdefault((t.g, t.cid, t.lo, t.hi), len(ranges))
    return ranges


def _join_ranges(long: DataFrame, ranges: dict) -> DataFrame:
    spark = long.sparkSession
    rows = [(rid, g, cid, lo, hi, (hi * 0.5 - lo * 0.5) / BINS)
            for (g, cid, lo, hi), rid in ranges.items()]
    rdf = spark.createDataFrame(rows, "rid int, g string, cid int, lo double, hi double, w double")
    if len(rows) <= BROADCAST_MAX:
        rdf = F.broadcast(rdf)
    return (long.join(rdf, ["g", "cid"])
                .filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))))


def _pick(counted: DataFrame, order_col: str, targets: list[_Target], ranges: dict):
    """Running count per range, then the row holding each target's rank."""
    run = Window.partitionBy("rid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("cum", F.sum("n").over(run))
    spark = counted.sparkSession
    tdf = spark.createDataFrame(
        [(i, ranges[(t.g, t.cid, t.lo, t.hi)], int(t.rank)) for i, t in enumerate(targets)],
        "tid int, rid int, r long")
    if len(targets) <= BROADCAST_MAX:
        tdf = F.broadcast(tdf)
    return (counted.join(tdf, "rid")
                   .filter((F.col("cum") - F.col("n") <= F.col("r")) & (F.col("r") < F.col("cum"))))


def _refine(long: DataFrame, targets: list[_Target]) -> None:
    ranges = _ranges(targets)
    j = _join_ranges(long, ranges)
    b = F.least(F.floor((F.col("x") * 0.5 - F.col("lo") * 0.5) / F.col("w")), F.lit(BINS - 1))
    hist = (j.groupBy("rid", b.cast("int").alias("b"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("blo"), F.max("x").alias("bhi")))
    for row in _pick(hist, "b", targets, ranges).select(
            "tid", "n", "blo", "bhi", (F.col("cum") - F.col("n")).alias("before")).collect():
        t = targets[row["tid"]]
        t.rank -= int(row["before"])
        t.lo, t.hi, t.n_in = float(row["blo"]), float(row["bhi"]), int(row["n"])
        if t.lo == t.hi:
            t.value, t.done = t.lo, True


def _finish(long: DataFrame, targets: list[_Target]) -> None:
    ranges = _ranges(targets)
    vals = _join_ranges(long, ranges).groupBy("rid", "x").agg(F.count(F.lit(1)).alias("n"))
    for row in _pick(vals, "x", targets, ranges).select("tid", "x").collect():
        t = targets[row["tid"]]
        t.value, t.done = float(row["x"]), True


def _infinities(long: DataFrame, series: dict) -> dict:
    """(g, cid) -> (values at -inf, values at +inf, least and greatest finite value)
    of the series whose range is infinite; the selection runs on the finite rest."""
    if not series:
        return {}
    wanted = long.sparkSession.createDataFrame(list(series), "g string, cid int")
    if len(series) <= BROADCAST_MAX:
        wanted = F.broadcast(wanted)
    low, high = F.col("x") == F.lit(-math.inf), F.col("x") == F.lit(math.inf)
    finite = F.when(~low & ~high, F.col("x"))
    rows = (long.join(wanted, ["g", "cid"]).groupBy("g", "cid")
                .agg(F.count_if(low).alias("below"), F.count_if(high).alias("above"),
                     F.min(finite).alias("lo"), F.max(finite).alias("hi")).collect())
    return {(r["g"], r["cid"]): (r["below"], r["above"], r["lo"], r["hi"]) for r in rows}


def order_statistics(long: DataFrame, requests: list[tuple], stats: dict) -> dict:
    """Exact k-th smallest values of series in a long frame.

    ``requests``: (key, (g, cid), rank) with 0-based rank; ``stats``:
    (g, cid) -> (n_non_null, min, max). Returns key -> float or None.
    """
    targets, keys, out = [], [], {}
    infinite = _infinities(long, {s: v for s, v in stats.items()
                                  if v[0] and not (math.isfinite(v[1]) and math.isfinite(v[2]))})
    for key, series, rank in requests:
        n, lo, hi = stats.get(series, (0, None, None))
        if not n or rank < 0 or rank >= n:
            out[key] = None
            continue
        if series in infinite:
            below, above, lo, hi = infinite[series]
            if rank < below or rank >= n - above:
                out[key] = -math.inf if rank < below else math.inf
                continue
            n, rank = n - below - above, rank - below
        t = _Target(series[0], series[1], int(rank), float(lo), float(hi), int(n))
        if t.lo == t.hi:
            t.value, t.done = t.lo, True
        targets.append(t)
        keys.append(key)
    stuck: set[int] = set()
    while True:
        pending = [t for t in targets if not t.done]
        if not pending:
            break
        small = [t for t in pending
                 if t.n_in <= FINAL_MAX or id(t) in stuck
                 or not math.isfinite((t.hi * 0.5 - t.lo * 0.5) / BINS)
                 or (t.hi * 0.5 - t.lo * 0.5) / BINS == 0.0]
        small_ids = {id(t) for t in small}
        large = [t for t in pending if id(t) not in small_ids]
        if large:
            before = {id(t): (t.lo, t.hi, t.n_in) for t in large}
            _refine(long, large)
            # a range that did not narrow (e.g. bounded by infinities) goes
            # to the exact pick instead of looping
            stuck |= {id(t) for t in large if not t.done and (t.lo, t.hi, t.n_in) == before[id(t)]}
        if small:
            _finish(long, small)
    for key, t in zip(keys, targets):
        out[key] = t.value
    return out


def _lerp(a: float, b: float, t: float) -> float:
    # numpy's linear interpolation, the one pandas' quantile uses
    d = b - a
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def _quantiles_long(long: DataFrame, series_stats: dict, probs: list[float]) -> dict:
    requests, plan = [], {}
    for s, (n, _, _) in series_stats.items():
        for p in probs:
            if not n:
                plan[(s, p)] = None
                continue
            h = (n - 1) * p
            lo = int(math.floor(h))
            hi = min(lo + 1, n - 1)
            plan[(s, p)] = (lo, hi, h - lo)
            requests.append(((s, lo), s, lo))
            requests.append(((s, hi), s, hi))
    uniq = list({r[0]: r for r in requests}.values())
    found = order_statistics(long, uniq, series_stats)
    out = {}
    for (s, p), spec in plan.items():
        if spec is None:
            out[(s, p)] = None
            continue
        lo, hi, frac = spec
        a, b = found[(s, lo)], found[(s, hi)]
        out[(s, p)] = a if frac == 0 or a == b else _lerp(a, b, frac)
    return out


def quantiles(df: DataFrame, columns: list[str], probs: list[float], stats: dict) -> dict:
    """Exact linear-interpolation quantiles: (column, p) -> float | None.

    ``stats``: column -> (n_non_null, min, max), from an aggregate the caller
    already ran.
    """
    if not columns:
        return {}
    long = long_values(df, columns)
    sstats = {("", i): stats[c] for i, c in enumerate(columns)}
    res = _quantiles_long(long, sstats, probs)
    return {(c, p): res[(("", i), p)] for i, c in enumerate(columns) for p in probs}


def _lerp_col(a, b, t):
    """numpy's linear interpolation as a column expression."""
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def grouped_quantiles_frame(df: DataFrame, group: str, columns: list[str],
                            probs: list[float]) -> DataFrame:
    """Exact quantiles per (group, column) as a DataFrame
    (g, cid, n, lo, hi, q0, q1, ...) for any number of groups.

    Groups whose column holds at most ``FINAL_MAX`` values are solved fully
    distributed: value counts per (group, column, value), a running count in
    a window bounded by the group size, the two order statistics around each
    rank picked by a conditional ``min``, and numpy's interpolation as a column
    expression. Larger (hot) groups -- at most rows / FINAL_MAX of them -- go
    through the selection passes of ``order_statistics``.
    """
    from functools import reduce
    from pyspark.sql import Window
    spark = df.sparkSession
    long = long_values(df, columns, group)
    stats = long.groupBy("g", "cid").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"),
                                         F.max("x").alias("hi"))
    stats = materialize_small(stats)
    qcols = [f"q{i}" for i in range(len(probs))]
    # small groups: distributed window over at most FINAL_MAX distinct values
    small = stats.filter(F.col("n") <= FINAL_MAX).select("g", "cid", "n")
    # broadcast the (checked) small-group table so that rows of a hot group are
    # filtered out map-side instead of being shuffled to one join task
    small_side = F.broadcast(small) if small.count() <= BROADCAST_MAX else small
    counted = (long.join(small_side, ["g", "cid"], "left_semi")
                   .groupBy("g", "cid", "x").agg(F.count(F.lit(1)).alias("c")))
    run = Window.partitionBy("g", "cid").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("cum", F.sum("c").over(run)).join(small, ["g", "cid"])
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1).cast("double") * F.lit(p)
        lo_r = F.floor(h)
        hi_r = F.least(lo_r + 1, F.col("n") - 1)
        def at(r):
            return F.min(F.when((F.col("cum") - F.col("c") <= r) & (r < F.col("cum")), F.col("x")))
        aggs += [at(lo_r).alias(f"a{i}"), at(hi_r).alias(f"b{i}"),
                 F.max(h - lo_r).alias(f"t{i}")]
    picked = counted.groupBy("g", "cid").agg(*aggs)
    small_q = picked.select("g", "cid", *[
        F.when((F.col(f"t{i}") == 0) | (F.col(f"a{i}") == F.col(f"b{i}")), F.col(f"a{i}"))
         .otherwise(_lerp_col(F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"t{i}"))).alias(qcols[i])
        for i in range(len(probs))])
    small_out = stats.filter(F.col("n") <= FINAL_MAX).join(small_q, ["g", "cid"])
    # large groups: bounded in number by rows / FINAL_MAX
    big_rows = stats.filter(F.col("n") > FINAL_MAX).collect()
    parts = [small_out]
    if big_rows:
        sstats = {(r["g"], r["cid"]): (r["n"], r["lo"], r["hi"]) for r in big_rows}
        res = _quantiles_long(long, sstats, probs)
        rows = [(g, cid, n, lo, hi, *[res[((g, cid), p)] for p in probs])
                for (g, cid), (n, lo, hi) in sstats.items()]
        schema = ("g string, cid int, n bigint, lo double, hi double, "
                  + ", ".join(f"{q} double" for q in qcols))
        parts.append(spark.createDataFrame(rows, schema))
    return reduce(DataFrame.unionByName, parts)


def materialize_small(df: DataFrame) -> DataFrame:
    from tabsmith.session import materialize
    return materialize(df)


def grouped_quantiles(df: DataFrame, group: str, columns: list[str],
                      probs: list[float]) -> tuple[dict, dict]:
    """``grouped_quantiles_frame`` collected into dicts (for a bounded number
    of groups): ({(group_key, column, p): value}, {(group_key, column): (n, min, max)})."""
    rows = grouped_quantiles_frame(df, group, columns, probs).collect()
    q = {(r["g"], columns[r["cid"]], p): r[f"q{i}"] for r in rows for i, p in enumerate(probs)}
    st = {(r["g"], columns[r["cid"]]): (r["n"], r["lo"], r["hi"]) for r in rows}
    return q, st


def column_stats(df: DataFrame, columns: list[str]) -> dict:
    """column -> (n_non_null, min, max) in one aggregate."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        x = as_double(c)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).collect()[0]
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}
