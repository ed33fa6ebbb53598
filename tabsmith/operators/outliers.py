"""Planning of the sequential z-score filter in a bounded number of scans (CL6).

The reference tests numeric columns in order, each with the mean and standard
deviation of the rows still left. One scan takes every column's moments. A
second sets apart the *far* rows, those that lie beyond SLACK times the test's
distance in some column or are not finite; all others are *near* and leave only
additive moments, by the first column they miss (where they will be removed).

The sequence then runs on the far rows and those moments: what a column removes
is subtracted, and the next column's statistics are those of what is left. Near
rows pass a test as long as their extremes do. Where earlier removals have
shrunk a deviation so far that they don't (or have made a column constant), the
rows still left are split once more with the new statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import NUMERIC, as_double, columns_info
from tabsmith.operators.profile import AGG_FIELDS, chunks
from tabsmith.session import save_once

#: Share of the test's distance beyond which a row is set apart.
SLACK = 0.8
#: Far cells (rows times columns) that the driver holds; beyond it the far rows stay a table.
DRIVER_CELLS = 2_000_000
FIELDS = ("n", "s", "q", "lo", "hi")


@dataclass
class OutlierStep:
    column: str
    mean: float | None
    std: float | None
    removed: int        # rows this column removed (0 for a skipped column)


def keep_test(x: Column, mean, std, z: float) -> Column | None:
    """Row survives a column's z-score test; None = column skipped.

    pandas semantics: std == 0 skips the column; a missing std (fewer than two
    values) compares False for every row; a missing cell compares False.
    """
    if std is not None and std == 0:
        return None
    if std is None or mean is None:
        return F.lit(False)
    return F.coalesce(F.abs((x - F.lit(mean)) / F.lit(std)) < F.lit(z), F.lit(False))


def _passes(x: float, mean, std, z: float) -> bool:
    return std is not None and abs((x - mean) / std) < z


def merged(parts: list[tuple]) -> tuple:
    """(n, s, q, lo, hi) of several parts: count, sums of x - centre and of its square, extremes."""
    parts = [p for p in parts if p[0]]
    if not parts:
        return (0, 0.0, 0.0, math.inf, -math.inf)
    return (sum(p[0] for p in parts), math.fsum(p[1] for p in parts), math.fsum(p[2] for p in parts),
            min(p[3] for p in parts), max(p[4] for p in parts))


def mean_std(sums: tuple, centre: float) -> tuple[float | None, float | None]:
    n, s, q, lo, hi = sums
    if not n:
        return None, None
    if lo == hi and math.isfinite(lo):      # exactly constant
        return lo, 0.0 if n > 1 else None
    mean = centre + s / n
    if not math.isfinite(s) or not math.isfinite(q):
        return mean, math.nan
    return mean, math.sqrt(max(q - s * s / n, 0.0) / (n - 1)) if n > 1 else None


# ------------------------------------------------------------------------- split

def _split(centres: list[float], limits: list[float | None], middles: list[float], classes: list[bool]):
    """Far rows (kind 0: x) and moments of near rows (kind 1: class, column, FIELDS; column -1: rows of the class).

    A row is far where it is ``limit`` or more from ``middle``; its class is the first missing column of ``classes``."""
    k = len(centres)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        limit = np.array([math.inf if v is None else v for v in limits])
        checked = np.array([v is not None for v in limits])
        active = np.array(classes)
        count = np.zeros(k + 1, np.int64)
        sums = np.zeros((3, k + 1, k))
        low, high = np.full((k + 1, k), math.inf), np.full((k + 1, k), -math.inf)

        def rows(kind, cls, column, values, x):
            m = len(kind)
            offsets = pa.array(np.arange(m + 1, dtype=np.int32) * (k if len(x) else 0))
            return pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(cls, pa.int32()), pa.array(column, pa.int32()), *[pa.array(v, pa.float64()) for v in values],
                 pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float64()))], names=["kind", "class", "column", *FIELDS, "x"])

        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)]).astype(float)
            here = ~np.isnan(x)
            with np.errstate(invalid="ignore", over="ignore"):
                far = ((here & checked) & (np.abs(x - np.array(middles)) >= limit)).any(axis=1) | np.isinf(x).any(axis=1)
            if far.any():
                m = int(far.sum())
                z = np.zeros(m)
                yield rows(np.zeros(m, np.int32), np.zeros(m, np.int32), np.zeros(m, np.int32), [z] * 5, x[far])
            x, here = x[~far], here[~far]
            missing = ~here & active
            cls = np.where(missing.any(axis=1), missing.argmax(axis=1), k)
            d = np.where(here, x - np.array(centres), 0.0)
            for c in np.unique(cls):
                of = cls == c
                count[c] += of.sum()
                sums[0, c] += here[of].sum(axis=0)
                sums[1, c] += d[of].sum(axis=0)
                sums[2, c] += (d[of] ** 2).sum(axis=0)
                low[c] = np.minimum(low[c], np.where(here[of], x[of], math.inf).min(axis=0))
                high[c] = np.maximum(high[c], np.where(here[of], x[of], -math.inf).max(axis=0))
        used = np.flatnonzero(count)
        if len(used):
            m = len(used)
            one, z = np.ones(m, np.int32), np.zeros(m)
            yield rows(one, used.astype(np.int32), -one, [count[used].astype(float), z, z, z, z], np.zeros((0, k)))
            cls, col = np.repeat(used, k), np.tile(np.arange(k), m)
            yield rows(np.ones(m * k, np.int32), cls.astype(np.int32), col.astype(np.int32),
                       [*(sums[i][cls, col] for i in range(3)), low[cls, col], high[cls, col]], np.zeros((0, k)))
    return run


SPLIT = "kind int, class int, column int, " + ", ".join(f"{f} double" for f in FIELDS) + ", x array<double>"


class Split:
    """The near moments and the far rows of one scan, less what the columns so far have removed."""

    def __init__(self, df: DataFrame, names: list[str], centres, limits, middles, classes):
        values = df.select(*[as_double(n).alias(f"x{i}") for i, n in enumerate(names)])
        self.k, self.centres = len(names), centres
        out = save_once(values.mapInArrow(_split(centres, limits, middles, classes), SPLIT), "outlier-split")
        # at most (columns + 1)^2 rows
        sums = (out.where("kind = 1").groupBy("class", "column")
                .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .collect())
        self.rows = {r["class"]: int(r.n) for r in sums if r["column"] == -1}
        self.near: dict[int, list[tuple[int, tuple]]] = {}
        for r in sums:
            if r["column"] >= 0 and r.n:
                self.near.setdefault(r["column"], []).append((r["class"], (int(r.n), r.s, r.q, r.lo, r.hi)))
        far = out.where("kind = 0").select("x")
        n = far.count()
        self.far = _DriverRows(far, centres) if n * self.k <= DRIVER_CELLS else _TableRows(far, centres)
        self.far_sums: dict[int, tuple] = {}

    def near_sums(self, column: int, p: int) -> tuple:
        """Moments of a column over the near rows that miss no column before ``p``."""
        return merged([s for c, s in self.near.get(column, []) if c >= p])

    def extremes(self, p: int) -> list[float]:
        """The extremes of column ``p`` over the near rows that the columns before it leave."""
        return [e for c, s in self.near.get(p, []) if c > p for e in s[3:]]

    def statistics(self, column: int, p: int) -> tuple[float | None, float | None]:
        """(mean, standard deviation) of a column over the rows that the columns before ``p`` leave."""
        if column not in self.far_sums:
            self.far_sums.update(self.far.sums(list(range(column, min(column + AGG_FIELDS // 6, self.k)))))
        return mean_std(merged([self.near_sums(column, p), self.far_sums[column]]), self.centres[column])

    def all_statistics(self, p: int) -> list[tuple[float | None, float | None]]:
        return [self.statistics(i, p) if i >= p else (None, None) for i in range(self.k)]

    def remove(self, p: int, mean, std, z: float) -> int:
        """Apply column ``p``'s test, which all near rows pass that have a value; the number of rows removed."""
        n = self.far.remove(p, mean, std, z)
        if n:
            self.far_sums.clear()
        return n + self.rows.get(p, 0)

    def clear(self, p: int) -> int:
        """Remove all rows that are left."""
        n = self.far.remove(p, None, None, 0.0) + sum(r for c, r in self.rows.items() if c >= p)
        self.rows, self.near = {}, {}
        self.far_sums.clear()
        return n


class _DriverRows:
    """A bounded number of far rows, as an array."""

    def __init__(self, far: DataFrame, centres):
        import numpy as np
        rows = far.collect()                # DRIVER_CELLS at most
        self.x = np.array([r.x for r in rows], float).reshape(len(rows), len(centres))
        self.centres = centres

    def sums(self, columns: list[int]) -> dict[int, tuple]:
        import numpy as np
        out = {}
        with np.errstate(invalid="ignore", over="ignore"):
            for i in columns:
                v = self.x[:, i]
                v = v[~np.isnan(v)]
                d = v - self.centres[i]
                out[i] = (len(v), float(d.sum()), float((d * d).sum()), float(v.min()), float(v.max())) if len(v) else merged([])
        return out

    def remove(self, i: int, mean, std, z: float) -> int:
        import numpy as np
        with np.errstate(invalid="ignore", over="ignore"):
            keep = np.abs((self.x[:, i] - mean) / std) < z if std is not None else np.zeros(len(self.x), bool)
        self.x = self.x[keep]
        return int((~keep).sum())


class _TableRows:
    """Any number of far rows, as a table under a growing predicate."""

    def __init__(self, far: DataFrame, centres):
        self.far, self.centres = far, centres

    def _x(self, i: int) -> Column:
        return F.nanvl(F.col("x")[i], F.lit(None).cast("double"))

    def sums(self, columns: list[int]) -> dict[int, tuple]:
        out = {}
        for part in chunks(columns, AGG_FIELDS // 6):
            aggs = []
            for i in part:
                d = self._x(i) - F.lit(self.centres[i])
                aggs += [F.count(d).alias(f"n{i}"), F.sum(d).alias(f"s{i}"), F.sum(d * d).alias(f"q{i}"),
                         F.min(self._x(i)).alias(f"lo{i}"), F.max(self._x(i)).alias(f"hi{i}")]
            row = self.far.agg(*aggs).first()
            out.update({i: tuple(row[f"{f}{i}"] for f in FIELDS) if row[f"n{i}"] else merged([]) for i in part})
        return out

    def remove(self, i: int, mean, std, z: float) -> int:
        keep = keep_test(self._x(i), mean, std, z)
        n = self.far.where(~keep).count() if keep is not None else 0
        if n:
            self.far = self.far.where(keep)
        return n


# ---------------------------------------------------------------------- sequence

def _first_values(df: DataFrame, names: list[str]) -> list[float]:
    """A finite value of each column's first rows, to take moments about (0 where there is none)."""
    head = df.select(*[as_double(n).alias(f"x{i}") for i, n in enumerate(names)]).limit(1000).collect()
    return [next((r[i] for r in head if r[i] is not None and math.isfinite(r[i])), 0.0) for i in range(len(names))]


def outlier_plan(df: DataFrame, z: float = 3.0) -> tuple[Column, list[OutlierStep]]:
    """The predicate that the sequential filter amounts to, and what each column removes."""
    names = [c.name for c in columns_info(df) if c.cls == NUMERIC]
    pred, steps = F.lit(True), []
    if not names:
        return pred, steps
    k = len(names)
    centres = _first_values(df, names)
    whole = Split(df, names, centres, [None] * k, centres, [False] * k)         # moments of all finite rows
    stats = [mean_std(whole.near_sums(i, 0), centres[i]) for i in range(k)]
    constant = {i for i in range(k) if stats[i][1] == 0}
    state: Split | None = None
    while len(steps) < k:
        p = len(steps)
        if state is None:
            # only a column with a spread sets rows apart
            limits = [SLACK * z * s if i >= p and s and not math.isnan(s) else None for i, (_, s) in enumerate(stats)]
            middles = [m if m is not None else 0.0 for m, _ in stats]
            classes = [i >= p and i not in constant for i in range(k)]
            state = Split(df.filter(pred), names, centres, limits, middles, classes)
        mean, std = state.statistics(p, p)
        if std is not None and std == 0:
            if p not in constant and state.rows.get(p):     # the rows that miss it stay, and need another class
                constant.add(p)
                stats, state = state.all_statistics(p), None
                continue
            steps.append(OutlierStep(names[p], mean, std, 0))
            continue
        if std is None or math.isnan(std):
            removed = state.clear(p)
        elif all(_passes(e, mean, std, z) for e in state.extremes(p)):
            removed = state.remove(p, mean, std, z)
        else:
            stats, state = state.all_statistics(p), None
            continue
        steps.append(OutlierStep(names[p], mean, std, removed))
        if removed:
            pred = pred & keep_test(as_double(names[p]), mean, std, z)
    return pred, steps
