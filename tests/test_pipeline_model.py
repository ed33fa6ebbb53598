"""A fitted preparation: train-only fills, raw rows in, the same scores after saving."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import automl as ml


def _rows(spark, n=400):
    rows = []
    for i in range(n):
        kind = ["red", "green", None, "blue"][i % 4]
        x = None if i % 5 == 0 else float(i % 40) + (1000.0 if i % 100 >= 80 and i % 7 == 0 else 0.0)
        y = "high" if (i % 40) >= 20 or kind == "blue" else "low"
        rows.append((i, x, kind, float("nan") if i % 9 == 0 else float(i % 3), y))
    return spark.createDataFrame(rows, "id long, x double, kind string, z double, y string")


@pytest.mark.parametrize("impute_on", ["train", "all"])
def test_preparation_equals_filling_then_scaling(spark, impute_on):
    df = _rows(spark)
    on = ml.split_expr(F.col("id")) == "train"
    prep, n = ml.fit_preparation(df, "y", ml.CLASSIFICATION, on, ("id",), impute_on)
    assert n == 400 and prep.features == ["x", "kind", "z"] and prep.categorical == ["kind"]
    got = {r["id"]: r["features"].toArray() for r in prep.feature_vector(df, ["id"]).collect()}
    p = df.toPandas().sort_values("id").reset_index(drop=True)
    p["kind"] = p["kind"].fillna("nan").map({v: i for i, v in enumerate(sorted(["red", "green", "nan", "blue"]))})
    train = p["id"] % 100 < 80
    for k, f in enumerate(["x", "kind", "z"]):
        x = p[f].astype(float)
        x = x.fillna((x[train] if impute_on == "train" else x).mean())
        want = (x - x[train].mean()) / x[train].std(ddof=0)
        assert np.allclose([got[i][k] for i in p["id"]], want, atol=1e-9)


def test_test_rows_do_not_reach_the_fills(spark):
    df = _rows(spark)
    wild = df.withColumn("x", F.when(F.col("id") % 100 >= 80, F.col("x") * 1e6).otherwise(F.col("x")))
    on = ml.split_expr(F.col("id")) == "train"
    a, _ = ml.fit_preparation(df, "y", ml.CLASSIFICATION, on, ("id",))
    b, _ = ml.fit_preparation(wild, "y", ml.CLASSIFICATION, on, ("id",))
    assert all(math.isclose(p, q) for p, q in zip(a.numbers["x"], b.numbers["x"]))


def test_saved_model_scores_raw_rows_alike(spark):
    df = _rows(spark)
    r = ml.auto_train(df, "y", split_key=F.col("id"), ids=("id",), cv=False)
    path = ml.save_pipeline(r, os.path.join(tempfile.mkdtemp(prefix="tabsmith-pipe-"), "m"), spark)
    saved = ml.load_pipeline(spark, path)
    cols = ["id", "prediction", "predicted_class"]
    raw = df.drop("y").withColumn("prediction", F.lit("taken"))         # no target, a clashing column
    a = ml.predict(r, raw).select(cols).orderBy("id").collect()
    assert a == saved.predict(raw).select(cols).orderBy("id").collect() and len(a) == 400
    test = ml.predict(r, df).filter("id % 100 >= 80")
    share = test.filter("predicted_class = y").count() / test.count()
    assert math.isclose(share, r.best.value)


def test_unseen_and_missing_values_are_defined(spark):
    df = _rows(spark)
    r = ml.auto_train(df, "y", split_key=F.col("id"), ids=("id",), cv=False)
    odd = spark.createDataFrame([(1, None, "violet", None), (2, float("nan"), None, 1.0), (3, 5.0, "", 0.0)],
                                "id long, x double, kind string, z double")
    got = {x["id"]: x["features"].toArray() for x in r.preparation.feature_vector(odd, ["id"]).collect()}
    fill, mean, std = r.preparation.numbers["kind"]
    assert math.isclose(got[1][1], (fill - mean) / std) and got[1][1] == got[3][1] != got[2][1]
    assert all(np.isfinite(v).all() for v in got.values())
    assert ml.predict(r, odd).filter("predicted_class in ('high', 'low')").count() == 3
    assert ml.predict(r, odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="Columns not found: z"):
        ml.predict(r, odd.drop("z"))


def test_numeric_target_and_a_column_without_values(spark):
    df = spark.range(500).select("id", (F.col("id") % 97).cast("double").alias("x"),
                                 F.lit(None).cast("double").alias("none"),
                                 ((F.col("id") % 97) * 3 + 1).cast("double").alias("y"))
    r = ml.auto_train(df, "y", split_key=F.col("id"), ids=("id",))
    line = next(s for s in r.scores if s.model == "Linear Regression")
    assert r.task == "regression" and line.error is None and line.value > 0.999
    off = ml.predict(r, df, "Linear Regression").agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert off < 1e-6
