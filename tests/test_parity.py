"""pandas parity on small and degenerate frames (FIXTURES F1, F8)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsmith.functions.columns import normalize_missing
from tabsmith.operators import charts, clean, profile
from tabsmith.sources.csv import normalize_labels


def _sdf(spark, pdf, schema):
    return normalize_missing(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None)
                                                   .values.tolist(), schema))


def test_mini_abc(spark):
    df = spark.createDataFrame([(1, 2, "x"), (2, 3, "y"), (3, 4, "x"), (4, 5, "y"), (5, 6, "x")],
                               "A long, B long, C string")
    assert clean.duplicate_count(df).first()["duplicate_rows"] == 0
    r = {(x["col_x"], x["col_y"]): x["r"] for x in profile.correlation_long(df).collect()}
    assert r[("A", "B")] == pytest.approx(1.0)
    assert clean.column_modes(df, ["C"]) == {"C": "x"}


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a double, b string")
    s = profile.dataset_summary(df).collect()
    assert [x["n_rows"] for x in s] == [0, 0]
    assert all(x["missing_pct"] is None for x in s)     # pandas: NaN
    d = profile.describe_statistics(df).first()
    assert d["count"] == 0 and d["mean"] is None and d["p50"] is None


def test_one_row(spark):
    df = spark.createDataFrame([(1.5, "a")], "a double, b string")
    d = profile.describe_statistics(df).first()
    assert d["std"] is None and d["p25"] == 1.5 and d["p75"] == 1.5   # pandas: std NaN
    assert clean.remove_outliers(df).count() == 0     # std missing -> every row compares False


def test_all_missing_and_constant(spark):
    rows = [(None, 5.0, 0.1, float(i)) for i in range(10)]
    df = normalize_missing(spark.createDataFrame(rows, "m double, c double, t double, v double"))
    filled = clean.fill_missing_mean(df)
    assert filled.filter("m IS NULL").count() == 10          # all-missing stays missing
    r = {(x["col_x"], x["col_y"]): x["r"] for x in charts.correlation_matrix(df.drop("m")).collect()}
    assert r[("c", "c")] is None and r[("v", "v")] == 1.0 and r[("c", "v")] is None
    h = charts.histogram(df.select("c"), 20).collect()
    assert sum(x["n"] for x in h) == 10
    assert min(x["lo"] for x in h) == 4.5 and max(x["hi"] for x in h) == 5.5  # range +-0.5
    # an all-missing column removes every row in the sequential z-score filter
    assert clean.remove_outliers(df).count() == 0


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert clean.column_modes(df, ["s"]) == {"s": "a"}
    assert pd.Series(["b", "a", "b", "a"]).mode()[0] == "a"
    assert clean.fill_missing_mode(df).filter("s IS NULL").count() == 0


def test_nan_equals_null(spark):
    df = normalize_missing(spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double"))
    s = profile.dataset_summary(df).first()
    assert s["missing"] == 2
    assert clean.duplicate_count(df).first()["duplicate_rows"] == 1   # NaN row == NULL row


def test_duplicate_labels():
    assert normalize_labels(["a", "a", "a"]) == ["a", "a_1", "a_2"]
    assert normalize_labels(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]
    assert normalize_labels(["x", "", "X"]) == ["x", "Unnamed: 1", "X_1"]


def test_boolean_only_table(spark):
    df = spark.createDataFrame([(True,), (False,)], "b boolean")
    assert profile.describe_statistics(df).count() == 0
    all_ = profile.describe_all(df).first()
    assert (all_["count"], all_["unique"]) == (2, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_quartiles_match_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    vals = np.round(rng.exponential(50, 5000), 2)
    vals[rng.random(5000) < 0.1] = np.nan
    pdf = pd.DataFrame({"x": vals})
    df = _sdf(spark, pdf, "x double")
    d = profile.describe_statistics(df, digits=10).first()
    exp = pdf["x"].describe()
    for ours, theirs in [("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"),
                         ("p75", "75%"), ("min", "min"), ("max", "max")]:
        assert d[ours] == pytest.approx(exp[theirs], rel=1e-12), ours


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = rng.normal(0, 1, 3000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    counts, edges = np.histogram(vals, bins=20)
    got = charts.histogram(df, 20).orderBy("bin").collect()
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["lo"] for r in got] == edges[:-1].tolist()
    auto = np.histogram_bin_edges(vals, bins="auto")
    assert charts.distributions(df).count() == len(auto) - 1


def test_kde_matches_scipy_formula(spark):
    rng = np.random.default_rng(3)
    vals = rng.gamma(2.0, 2.0, 800)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = charts.kde(df, ["x"], 25).orderBy("point").collect()
    h = vals.std(ddof=1) * len(vals) ** (-0.2)
    grid = np.linspace(vals.min(), vals.max(), 25)
    dens = np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / h) ** 2).sum(1) / (
        len(vals) * h * math.sqrt(2 * math.pi))
    assert [r["x"] for r in got] == pytest.approx(grid.tolist(), rel=1e-12)
    assert [r["density"] for r in got] == pytest.approx(dens.tolist(), rel=1e-9)


def test_box_matches_matplotlib_rule(spark):
    rng = np.random.default_rng(11)
    vals = np.round(rng.lognormal(3, 1, 2000), 3)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    b = charts.box_stats(df).first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    iqr = q3 - q1
    hi = vals[vals <= q3 + 1.5 * iqr].max()
    lo = vals[vals >= q1 - 1.5 * iqr].min()
    assert (b["q1"], b["median"], b["q3"]) == pytest.approx((q1, med, q3), rel=1e-12)
    assert (b["whisker_lo"], b["whisker_hi"]) == (lo, hi)
    assert b["fliers"] == int(((vals < lo) | (vals > hi)).sum())


def test_sequential_outliers_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 3000), "b": rng.standard_cauchy(3000),
                        "c": rng.exponential(1, 3000)})
    pdf.loc[rng.random(3000) < 0.05, "b"] = np.nan
    df = _sdf(spark, pdf, "a double, b double, c double")
    exp = pdf.copy()
    for c in exp.columns:
        m, s = exp[c].mean(), exp[c].std()
        if s == 0:
            continue
        exp = exp[((exp[c] - m) / s).abs() < 3]
    assert clean.remove_outliers(df).count() == len(exp)


def _plain_kde(v, points):
    v = np.asarray(v, float)
    h = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), points)
    return np.exp(-0.5 * ((v[:, None] - grid) / h) ** 2).sum(axis=0) / (len(v) * h * np.sqrt(2 * np.pi)), h


def test_kde_is_the_plain_sum(spark):
    rng = np.random.default_rng(8)
    series = {"spread": rng.exponential(50, 5000), "far": np.append(rng.normal(0, 1, 4000), [1e6, -3e5]),
              "tied": rng.integers(0, 3, 3000).astype(float), "two": np.array([1.0, 1.0 + 1e-9]),
              "shifted": 1e9 + rng.normal(0, 1, 2000), "one": np.array([5.0]), "constant": np.full(50, 2.0)}
    df = spark.createDataFrame([(k, float(x)) for k, v in series.items() for x in v], "g string, x double")
    for points in (50, 7):
        got = {}
        for r in charts.kde(df, ["x"], points, by="g").collect():
            got.setdefault(r["group"], {})[r["point"]] = (r["x"], r["density"])
        assert set(got) == set(series) - {"one", "constant"}
        for k in got:
            want, h = _plain_kde(series[k], points)
            dens = np.array([got[k][i + 1][1] for i in range(points)])
            x = np.array([got[k][i + 1][0] for i in range(points)])
            assert np.allclose(x, np.linspace(series[k].min(), series[k].max(), points), rtol=1e-12)
            # in units of one kernel's peak, a value: far within 1e-9
            assert np.abs(dens - want).max() * h < (1e-12 if k != "shifted" else 1e-7), k


def test_kde_work_does_not_grow_with_points(spark):
    """The pass over the values sums moments; the grid meets cells only."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    plans = [charts.kde(df, ["x"], p)._jdf.queryExecution().executedPlan().toString() for p in (50, 500)]
    assert len(plans[1]) < 1.1 * len(plans[0])


def test_hermite_polynomials():
    assert charts.hermite(0) == [1] and charts.hermite(1) == [0, 1]
    assert charts.hermite(4) == [3, 0, -6, 0, 1] and charts.hermite(5) == [0, 15, 0, -10, 0, 1]


def _pairs(df):
    return {(r["col_x"], r["col_y"]): r["r"] for r in profile.correlation_long(df).collect()}


@pytest.mark.parametrize("k", [3, 8])
def test_correlation_leaves_infinities_out(spark, k):
    """As pandas does, whatever the number of columns."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({f"c{i}": rng.normal(0, 1, 60) for i in range(k)})
    pdf["c1"] += pdf["c0"]
    pdf.loc[7, "c0"], pdf.loc[9, "c0"], pdf.loc[11, "c2"] = np.inf, -np.inf, np.nan
    pdf.loc[[7, 9], "c1"] = np.nan                  # missing wherever the other is infinite
    df = _sdf(spark, pdf, ", ".join(f"c{i} double" for i in range(k)))
    want = pdf.replace([np.inf, -np.inf], np.nan).corr()
    got = _pairs(df)
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-12 for a, b in got) and len(got) == k * (k - 1) // 2
    top = profile.correlation_pairs(df, 1).first()
    assert (top["col_x"], top["col_y"]) == ("c0", "c1")
    diagonal = {r["col_x"]: r["r"] for r in charts.correlation_matrix(df).where("i = j").collect()}
    assert set(diagonal.values()) == {1.0}


def test_correlation_keeps_digits(spark):
    """Columns far from their first values, nearly constant ones, and constant ones."""
    rng = np.random.default_rng(6)
    n = 3000
    a = np.r_[np.full(1500, 1e12), rng.normal(0, 1, n - 1500)]
    b = np.r_[np.full(1500, np.nan), rng.normal(0, 1, n - 1500)]
    b[1500:] += a[1500:]
    pdf = pd.DataFrame({"a": a, "b": b, "near": 1e9 + rng.normal(0, 1e-3, n), "same": np.full(n, 0.1), "none": np.full(n, np.nan)})
    df = _sdf(spark, pdf, "a double, b double, near double, same double, none double")
    got, want = _pairs(df), pdf.assign(near=pdf["near"] - 1e9).corr()          # pandas itself loses digits at 1e9
    for (x, y), r in got.items():
        if "same" in (x, y) or "none" in (x, y):
            assert r is None
        else:
            assert abs(r - want.loc[x, y]) < 1e-6, (x, y)
    diagonal = {r["col_x"]: r["r"] for r in charts.correlation_matrix(df).where("i = j").collect()}
    assert diagonal == {"a": 1.0, "b": 1.0, "near": 1.0, "same": None, "none": None}
