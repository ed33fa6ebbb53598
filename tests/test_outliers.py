"""The planned outlier sequence against pandas, column by column."""

import numpy as np
import pandas as pd
import pytest

from tabsmith.operators import clean, outliers


def chain(pdf, z=3.0):
    """The sequential filter and the rows each column removes."""
    removed = []
    for c in pdf.columns:
        m, s = pdf[c].mean(), pdf[c].std()
        keep = pd.Series(True, pdf.index) if s == 0 else ((pdf[c] - m) / s).abs() < z
        removed.append(int((~keep).sum()))
        pdf = pdf[keep]
    return pdf, removed


def frame(spark, pdf):
    rows = [[None if v != v else float(v) for v in r] for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in pdf.columns))


def check(spark, pdf, z=3.0):
    df = frame(spark, pdf)
    want, removed = chain(pdf, z)
    pred, steps = outliers.outlier_plan(df, z)
    assert [s.removed for s in steps] == removed
    got = sorted(map(repr, (tuple(r) for r in df.filter(pred).collect())))
    rows = [tuple(None if v != v else float(v) for v in r) for r in want.itertuples(index=False)]
    assert got == sorted(map(repr, rows))


def data(seed, n=2000, k=6):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({f"c{i}": [rng.normal(50 * i, 1 + i, n), rng.exponential(3, n), rng.integers(0, 4, n).astype(float),
                                  rng.standard_cauchy(n), np.full(n, 7.0), 1e9 + rng.normal(0, 1, n)][i % 6] for i in range(k)})
    return rng, pdf


@pytest.mark.parametrize("cells", [outliers.DRIVER_CELLS, 0])
def test_matches_the_chain(spark, monkeypatch, cells):
    monkeypatch.setattr(outliers, "DRIVER_CELLS", cells)        # far rows on the driver, or as a table
    rng, pdf = data(1)
    check(spark, pdf)
    for c in pdf.columns[::2]:
        pdf.loc[rng.random(len(pdf)) < 0.1, c] = np.nan
    check(spark, pdf)


def test_deviations_that_shrink(spark):
    """Rows extreme in every column hide the others until an early column removes them."""
    rng, pdf = data(2, 1500, 4)
    wild = rng.random(len(pdf)) < 0.01
    for i, c in enumerate(pdf.columns):
        pdf.loc[wild, c] = 1e6 * (i + 1)
    check(spark, pdf)
    check(spark, pdf, z=1.0)


def test_columns_that_become_constant(spark):
    n = 400
    pdf = pd.DataFrame({"a": np.r_[np.zeros(n), 100.0], "b": np.r_[np.full(n, 3.0), 9.0], "c": np.arange(n + 1.0), "d": np.r_[np.full(n, 1.0), 1.0]})
    check(spark, pdf)
    pdf.loc[5:30, "b"] = np.nan             # stays: b has no spread once a's outlier is gone
    pdf.loc[40:60, "d"] = np.nan
    check(spark, pdf)


def test_nothing_left(spark):
    check(spark, pd.DataFrame({"a": [1.0, 2.0, 3.0], "b": [np.nan] * 3, "c": [1.0, 2.0, 3.0]}))
    check(spark, pd.DataFrame({"a": [1.0], "b": [2.0]}))
    check(spark, pd.DataFrame({"a": [np.nan, 1.0, 1.0], "b": [1.0, np.nan, 5.0]}))
    empty = frame(spark, pd.DataFrame({"a": [1.0]})).where("false")
    assert clean.remove_outliers(empty).collect() == []


def test_infinite_cells(spark):
    pdf = pd.DataFrame({"a": np.r_[np.arange(50.0), np.inf], "b": np.arange(51.0)})
    check(spark, pdf)
    pdf = pd.DataFrame({"b": np.r_[np.arange(50.0), 1e9], "a": np.r_[np.arange(50.0), np.inf]})
    check(spark, pdf)                       # gone before its column is tested


def test_scans_do_not_grow_with_columns(spark, monkeypatch):
    made = []
    split = outliers.Split
    monkeypatch.setattr(outliers, "Split", lambda *a: made.append(1) or split(*a))
    rng = np.random.default_rng(3)
    for k in (4, 16):
        made.clear()
        pdf = pd.DataFrame({f"c{i}": rng.normal(0, 1, 1200) for i in range(k)})
        _, removed = chain(pdf)
        assert sum(r > 0 for r in removed) >= k - 1
        check(spark, pdf)
        assert len(made) == 2
