"""Golden numbers of FIXTURES.md (sf0.01), computed independently with pandas
when the fixtures were written."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tabsmith.operators import automl as ml
from tabsmith.operators import charts, clean, profile
from tabsmith.sources import fixtures as fx


@pytest.fixture(scope="module")
def dirty(spark):
    return fx.dirty_lineitem(spark, SF001).cache()


@pytest.fixture(scope="module")
def events(spark):
    return fx.events(spark, SF001).cache()


def test_shape_duplicates_missing(dirty):
    s = {r["column"]: r for r in profile.dataset_summary(dirty).collect()}
    assert s["l_orderkey"]["n_rows"] == 61176
    assert s["l_orderkey"]["n_columns"] == 8
    assert s["l_orderkey"]["duplicate_rows"] == 1177
    assert s["l_quantity"]["missing"] == 8878 and s["l_quantity"]["missing_pct"] == 14.5
    assert s["l_extendedprice"]["missing"] == 5497 and s["l_extendedprice"]["missing_pct"] == 9.0
    assert s["l_returnflag"]["missing"] == 4637 and s["l_returnflag"]["missing_pct"] == 7.6
    assert clean.drop_missing_rows(dirty).count() == 43938


def test_describe(dirty):
    d = {r["column"]: r for r in profile.describe_statistics(dirty).collect()}
    q = d["l_quantity"]
    assert (q["count"], q["mean"], q["std"], q["p25"], q["p50"], q["p75"]) == \
        (52298, 25.3977, 14.4365, 13.0, 25.0, 38.0)
    p = d["l_extendedprice"]
    assert (p["count"], p["mean"], p["std"], p["min"], p["max"]) == \
        (55679, 54237.5662, 50139.6505, 901.82, 2095133.0)
    assert (p["p25"], p["p50"], p["p75"]) == (26953.10, 53021.37, 79276.83)
    k = d["l_orderkey"]
    assert (k["mean"], k["std"], k["p25"], k["p50"], k["p75"]) == \
        (7522.5486, 4318.5813, 3796.0, 7523.0, 11245.0)


def test_top_values_and_mode(dirty):
    tv = {(r["column"], r["value"]): r["count"] for r in profile.top_values(dirty).collect()}
    assert tv[("l_returnflag", "R")] == 18890
    assert tv[("l_returnflag", "A")] == 18882
    assert tv[("l_returnflag", "N")] == 18767
    assert tv[("l_linestatus", "O")] == 30682 and tv[("l_linestatus", "F")] == 30494
    assert clean.column_modes(dirty, ["l_returnflag"]) == {"l_returnflag": "R"}


def test_fill_mean_median(dirty):
    m = clean._numeric_fill_stats(dirty, median=False)
    assert m["l_quantity"] == pytest.approx(25.39766339056943, abs=1e-12)
    med = clean._numeric_fill_stats(dirty, median=True)
    assert med == {"l_quantity": 25.0, "l_extendedprice": 53021.37}


def test_sequential_outliers(dirty):
    pred, steps = clean.outlier_plan(dirty)
    removed = {s.column: s.removed for s in steps}
    assert removed == {"l_orderkey": 0, "l_linenumber": 0, "l_quantity": 8878,
                       "l_extendedprice": 4762, "l_discount": 0, "l_tax": 0}
    assert dirty.count() - dirty.filter(pred).count() == 13640


def test_top_correlations(dirty):
    top = profile.correlation_pairs(dirty, 3).collect()
    got = [(r["col_x"], r["col_y"], round(r["abs_r"], 6)) for r in top]
    assert got == [("l_orderkey", "l_tax", 0.008448), ("l_orderkey", "l_discount", 0.007049),
                   ("l_linenumber", "l_tax", 0.006859)]


def test_events_value_goldens(events):
    d = {r["column"]: r for r in profile.describe_statistics(events).collect()}
    v = d["value"]
    assert (v["mean"], v["p25"], v["p50"], v["p75"]) == (49.6307, 14.56, 34.59, 69.1475)
    h = charts.histogram(events, 20, ["value"]).orderBy("bin").collect()
    assert [r["n"] for r in h] == [3854, 2409, 1449, 916, 532, 336, 192, 127, 67, 51, 25, 18,
                                   8, 9, 4, 2, 0, 0, 0, 1]
    b = charts.box_stats(events, ["value"]).first()
    assert (b["whisker_lo"], b["whisker_hi"], b["fliers"]) == (0.01, 150.89, 463)
    dist = charts.distributions(events, ["value"])
    assert dist.count() == 97
    k = charts.kde(events, ["value"], 50).orderBy("point").limit(3).collect()
    # the golden values carry 9 decimals
    assert [r["density"] for r in k] == pytest.approx([0.008872369, 0.014280582, 0.013460223],
                                                      abs=1.5e-9)


def test_events_outliers(events):
    _, steps = clean.outlier_plan(events)
    assert {s.column: s.removed for s in steps} == {"event_id": 0, "user_id": 0, "value": 182}


def test_split_sizes(spark):
    li = fx.ml_reg_linear(spark, SF001)
    key = F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729
    assert li.filter(ml.split_expr(key) == "train").count() == 47954


def test_task_edge(spark):
    part = fx.ml_task_edge(spark, SF001)
    t20 = ml.detect_task_type(part.filter(F.col("p_size") <= 20), "p_size").first()
    t21 = ml.detect_task_type(part.filter(F.col("p_size") <= 21), "p_size").first()
    assert (t20["unique"], t20["task"]) == (20, "classification")
    assert (t21["unique"], t21["task"]) == (21, "regression")
    lab = ml.detect_task_type(fx.labels_join(spark, SF001), "quality").first()
    assert lab["task"] == "classification"


def test_classification_rule_is_learnt(spark):
    r = ml.auto_train(fx.ml_class_rule(spark, SF001), "level",
                      split_key=F.col("event_id") * 7919, ids=("event_id",))
    assert r.task == "classification" and r.n_train == 8000 and r.n_test == 2000
    assert r.best is not None and r.best.value > 0.95, [(s.model, s.value, s.error) for s in r.scores]
    assert all(s.cv_mean is not None for s in r.scores), [(s.model, s.error) for s in r.scores]


def test_linear_target_regression(spark):
    df = fx.ml_reg_linear(spark, SF001)
    key = F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729
    r = ml.auto_train(df, "y", split_key=key, ids=("l_orderkey", "l_linenumber"))
    assert r.task == "regression"
    lin = next(s for s in r.scores if s.model == "Linear Regression")
    assert lin.value > 0.99
    assert r.best.model == "Linear Regression"
