"""Pearson correlation of all column pairs, pairwise deletion, in one pass.

A cell that is missing or not finite leaves its row out of the column's pairs,
as in pandas. Each task multiplies its batches as matrices of values less a
centre (0 where missing) and of presence, which gives every pair's count, sums,
squares and products at once; the tasks' sums meet in one aggregate, whose rows
are set by the columns alone. Where a column's spread within a pair is small
against its distance from the centre, so that the difference of sums would lose
digits, the pair is taken again by Spark's own covariance. A column without
spread among a pair's rows has a NULL correlation (pandas gives NaN there).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import as_double

#: Spread over distance from the centre (as squares) below which a pair is taken again.
LOST = 1e-8
#: Pairs of one aggregate of Spark's covariance: ten buffer fields each, within code generation.
PAIRS_A_PASS = 8


def finite(name: str) -> Column:
    x = as_double(name)
    return F.when(F.abs(x) < F.lit(math.inf), x)        # a NaN is larger than infinity here


def pair_corr(a: str, b: str) -> Column:
    """r of two columns; ``try_divide`` makes a zero spread NULL (``F.corr`` raises under ANSI rules)."""
    x, y = finite(a), finite(b)
    xa = F.when(y.isNotNull(), x)
    yb = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(xa, yb), F.stddev_samp(xa) * F.stddev_samp(yb))


def centres(df: DataFrame, names: list[str]) -> list[float]:
    """A finite value of the middle of each column's first rows (0 where there is none)."""
    head = df.select(*[as_double(n).alias(f"x{i}") for i, n in enumerate(names)]).limit(1000).collect()
    out = []
    for i in range(len(names)):
        v = sorted(r[i] for r in head if r[i] is not None and math.isfinite(r[i]))
        out.append(v[len(v) // 2] if v else 0.0)
    return out


def matrix_corr(df: DataFrame, names: list[str]) -> dict[tuple[int, int], float | None]:
    """r of all pairs i <= j of columns; of a column with itself 1.0, NULL without spread."""
    k = len(names)
    about = centres(df, names)

    def partial(batches):
        import numpy as np
        import pyarrow as pa
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)]).astype(float)
            here = np.isfinite(x)
            x = np.where(here, x - np.array(about), 0.0)
            m = here.astype(float)
            with np.errstate(invalid="ignore", over="ignore"):
                n += m.T @ m
                s += x.T @ m            # [i, j]: the sum of column i where j is there too
                q += (x * x).T @ m
                p += x.T @ x
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_pydict({
            "i": i.astype(np.int32), "j": j.astype(np.int32), "n": n[i, j], "si": s[i, j], "sj": s[j, i],
            "qi": q[i, j], "qj": q[j, i], "p": p[i, j]})

    fields = ("n", "si", "sj", "qi", "qj", "p")
    sums = (df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(names)])
            .mapInArrow(partial, "i int, j int, " + ", ".join(f"{f} double" for f in fields))
            .groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in fields]).collect())
    out, again = {(i, j): None for i in range(k) for j in range(i, k)}, []
    for r in sums:
        if r.n < 2 or r.qi == 0 or r.qj == 0:           # all at the centre: constant
            continue
        vi, vj = r.qi - r.si * r.si / r.n, r.qj - r.sj * r.sj / r.n
        if not (vi > LOST * r.qi and vj > LOST * r.qj and math.isfinite(vi) and math.isfinite(vj)):
            again.append((r.i, r.j))
        else:
            out[r.i, r.j] = 1.0 if r.i == r.j else (r.p - r.si * r.sj / r.n) / (math.sqrt(vi) * math.sqrt(vj))
    for at in range(0, len(again), PAIRS_A_PASS):
        part = again[at:at + PAIRS_A_PASS]
        row = df.agg(*[pair_corr(names[i], names[j]).alias(f"r{k}") for k, (i, j) in enumerate(part)]).first()
        for (i, j), r in zip(part, row):
            out[i, j] = r if r is None or i != j else 1.0
    return out
