"""Wide tables, map columns, infinities, many series, class targets and CSV
inputs that an ordinary user meets."""

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsmith.functions import quantiles as Q
from tabsmith.functions.duplicates import drop_duplicate_rows, duplicate_stats
from tabsmith.operators import automl as ml
from tabsmith.operators import charts, clean, profile
from tabsmith.operators import querylog as ql
from tabsmith.sources.csv import load_csv, write_csv
from tabsmith.sources.dataset import frames_differ


def wide(spark, k, n=400):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) + rng.normal(size=k) * 100
    x[rng.random((n, k)) < 0.05] = np.nan
    x[0, ::3] *= 40
    x[:, -1] = 7.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(k)])
    df = spark.createDataFrame(pdf).select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in pdf.columns])
    return pdf, df.repartition(4).cache()


@pytest.mark.parametrize("k", [20, 30, 100])
def test_wide_tables(spark, k):
    pdf, df = wide(spark, k)
    want = pdf.corr()
    got = {(r.col_x, r.col_y): r.r for r in profile.correlation_long(df).collect()}
    assert len(got) == k * (k - 1) // 2
    for (a, b), r in got.items():
        assert (r is None and math.isnan(want.loc[a, b])) or abs(r - want.loc[a, b]) < 1e-9
    assert charts.correlation_matrix(df).count() == k * k
    desc = pdf.describe()
    mom = profile.numeric_moments(df, list(pdf.columns))
    assert all(abs(mom[c]["std"] - desc.loc["std", c]) < 1e-6 * (1 + desc.loc["std", c]) for c in pdf.columns)
    assert profile.missing_counts(df) == {i + 1: int(v) for i, v in enumerate(pdf.isna().sum())}
    if k <= 30:
        left = pdf
        for c in pdf.columns:
            sd = left[c].std()
            if sd != 0:
                left = left[((left[c] - left[c].mean()) / sd).abs() < 3]
        assert clean.remove_outliers(df).count() == len(left)
    df.unpersist()


def test_rows_that_differ_in_a_map_stay(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2}), (1, {"a": 1}), (2, None), (2, None)],
                               "k int, m map<string,int>")
    assert drop_duplicate_rows(df).count() == 3
    assert duplicate_stats(df).distinct == 3
    two = df.select("k", F.map_from_entries(F.array(F.struct(F.lit("x"), F.lit(1)), F.struct(F.lit("y"), F.lit(2)))).alias("m"))
    swap = df.select("k", F.map_from_entries(F.array(F.struct(F.lit("y"), F.lit(2)), F.struct(F.lit("x"), F.lit(1)))).alias("m"))
    assert drop_duplicate_rows(two.unionByName(swap)).count() == 2       # equal whatever the order of entries
    nested = df.select(F.array(F.struct(F.col("m").alias("m"))).alias("a"), F.lit(-0.0).alias("z"))
    assert duplicate_stats(nested).distinct == 3
    assert frames_differ(df, drop_duplicate_rows(df)).first().asDict() == {
        "differs": True, "rows_a": 5, "rows_b": 3, "only_in_a": 2, "only_in_b": 0}
    assert not frames_differ(df, df.repartition(3)).first().differs


def test_quantiles_with_infinities_narrow(spark, monkeypatch):
    monkeypatch.setattr(Q, "FINAL_MAX", 50)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=4000), [math.inf] * 30, [-math.inf] * 20])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    passes = []
    finish = Q._finish

    def watch(long, targets):
        passes.append(max(t.n_in for t in targets))
        finish(long, targets)
    monkeypatch.setattr(Q, "_finish", watch)
    st = Q.column_stats(df, ["x"])
    got = Q.quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0], st)
    assert got[("x", 0.0)] == -math.inf and got[("x", 1.0)] == math.inf
    want = pd.Series(x).quantile([0.25, 0.5, 0.75])
    assert all(abs(got[("x", p)] - want[p]) < 1e-12 for p in want.index)
    assert max(passes) <= 50                       # the exact pick saw narrowed ranges only


def test_kde_of_many_series(spark, monkeypatch):
    monkeypatch.setattr(charts, "BROADCAST_MAX", 5)
    df = spark.range(3000).select((F.col("id") % 300).cast("string").alias("g"), (F.rand(1) * 10).alias("v"))
    got = charts.kde(df, ["v"], points=5, by="g")
    assert got.select("group").distinct().count() == 300 and got.count() == 1500


@pytest.mark.parametrize("values", [(-1, 1), (2019, 2020, 2021), (0.5, 1.5), ("no", "yes")])
def test_class_targets_of_any_value(spark, values):
    n = len(values)
    rows = [(i, float(i % (7 * n)), values[(i % (7 * n)) // 7]) for i in range(420)]
    df = spark.createDataFrame(rows, "id long, x double, y " + ("string" if isinstance(values[0], str) else "double" if isinstance(values[0], float) else "int")) \
        if not isinstance(values[0], float) else spark.createDataFrame(rows, "id long, x double, y double")
    r = ml.auto_train(df, "y", split_key=F.col("id"), ids=("id",))
    assert r.classes == [v if isinstance(v, str) else float(v) for v in values]
    assert [s.error for s in r.scores] == [None, None]
    assert all(s.value is not None and s.cv_mean is not None for s in r.scores)
    forest = next(s for s in r.scores if s.model == "Random Forest")
    assert forest.value > 0.99
    pred = ml.predict(r, df.withColumn("label", F.lit(0.0)), "Random Forest")
    assert pred.filter(F.col("predicted_class") != F.col("y")).count() == 0


def test_more_than_a_hundred_classes(spark):
    df = spark.range(2400).select("id", (F.col("id") % 120).cast("double").alias("x"),
                                  F.concat(F.lit("c"), (F.col("id") % 120).cast("string")).alias("y"))
    r = ml.auto_train(df, "y", split_key=F.expr("id div 120"), ids=("id",), cv=False, forest_depth=12)
    assert len(r.classes) == 120 and [s.error for s in r.scores] == [None, None]


# ----------------------------------------------------------------------------- CSV

def _write(data: bytes) -> str:
    p = os.path.join(tempfile.mkdtemp(prefix="tabsmith-csv-"), "x.csv")
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_numbers_with_a_letter_stay_text(spark):
    df = load_csv(spark, _write(b"a,b,c,d\n12f,7d,1e3, 4\n1,5D,.5,+6\n"))
    assert dict(df.dtypes) == {"a": "string", "b": "string", "c": "double", "d": "bigint"}
    assert [tuple(r) for r in df.collect()] == [("12f", "7d", 1000.0, 4), ("1", "5D", 0.5, 6)]


def test_quoted_line_breaks_are_found(spark):
    df = load_csv(spark, _write(b'a,b\n1,"two\nlines, ""quoted"""\n2,x\n'))
    assert sorted(tuple(r) for r in df.collect()) == [(1, 'two\nlines, "quoted"'), (2, "x")]


def test_a_replacement_character_is_a_character(spark):
    text = "name,n\ncafé �,1\n"
    assert load_csv(spark, _write(text.encode())).first()["name"] == "café �"
    assert load_csv(spark, _write("name,n\ncafé,1\n".encode("latin-1"))).first()["name"] == "café"


def test_whole_texts_survive(spark):
    rows = [(1, ' lead, "q" \n\nend '), (2, "plain"), (3, 'a\\"b\\'), (4, ",")]
    df = spark.createDataFrame(rows, "i long, t string")
    path = write_csv(df, tempfile.mkdtemp(prefix="tabsmith-csv-") + "/t", whole_texts=True)
    assert sorted(tuple(r) for r in load_csv(spark, path).collect()) == rows


def test_last_model_result_in_context_and_output(spark):
    log = spark.createDataFrame([(1, 0, "show data", "out"), (1, 2, "train ML models", "Accuracy 1"), (2, 0, "hi", "x")],
                                "conv_id long, turn long, query string, output string")
    turns = ql.conversation_turns(log)
    res = spark.createDataFrame([(1, "{'task': 'classification'}")], "conv_id long, ml_result string")
    got = {r.conv_id: r.context for r in ql.recent_context(ql.append_turn(turns, "d", 1, 2), ml_results=res).collect()}
    assert got[1].endswith("\n\nLast ML result: {'task': 'classification'}") and "Last ML" not in got[2]
    out = {r.conv_id: r.last_ml_result for r in ql.last_output(turns, res).collect()}
    assert out == {1: "{'task': 'classification'}", 2: None}
    assert {r.dataset for r in ql.session_summary(turns, "d").collect()} == {"d"}
