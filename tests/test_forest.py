"""Forests over packed rows: both ways of growing give the same trees, which fit as Spark's own do."""

import re

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabsmith.operators import automl as ml
from tabsmith.operators import forest as fo


def _rows(spark, n=6000):
    rng = np.random.default_rng(3)
    x, y, z = rng.normal(size=n), rng.integers(0, 7, n), rng.random(n)
    c = (x + 0.3 * y > 1).astype(int) + (z > 0.8)
    df = spark.createDataFrame([(int(i), float(a), float(b), float(e), float(k), float(3 * a - b + 2 * e))
                                for i, (a, b, e, k) in enumerate(zip(x, y, z, c))],
                               "id long, x double, y double, z double, c double, r double")
    return VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(df).repartition(5, "id").persist()


def _splits(model):
    """The trees without the figures that adding up in another order may round."""
    return [re.sub(r"Predict: \S+", "", line) for line in model.toDebugString.split("\n")[1:]]


@pytest.mark.parametrize("classify", [True, False])
def test_cells_and_levels_grow_the_same_trees(spark, monkeypatch, classify):
    df = _rows(spark).withColumn("label", F.col("c" if classify else "r"))
    two = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df.drop("features"))
    cells = fo.Forest(classify, 7, 5, 1).fit(two)
    monkeypatch.setattr(fo, "CELLS", 0)
    monkeypatch.setattr(fo, "ENTRY_BYTES", 10_000)      # a level's nodes in several ranges
    monkeypatch.setattr(fo, "COUNT_BYTES", 40_000)      # and some trees at a time
    levels = fo.Forest(classify, 7, 5, 1).fit(two)
    assert _splits(cells) == _splits(levels) and cells.totalNumNodes > 100
    again = fo.Forest(classify, 7, 5, 1).fit(two)
    assert again.toDebugString.split("\n")[1:] == levels.toDebugString.split("\n")[1:]


@pytest.mark.parametrize("classify", [True, False])
def test_as_good_as_sparks_forest(spark, classify):
    df = _rows(spark).withColumn("label", F.col("c" if classify else "r"))
    train, test = df.filter("id % 5 < 4"), df.filter("id % 5 = 4")
    ours = fo.Forest(classify, 30, 6, 42).fit(train)
    make = RandomForestClassifier if classify else RandomForestRegressor
    spark_ml = make(numTrees=30, maxDepth=6, maxBins=128, seed=42, featureSubsetStrategy="sqrt" if classify else "all").fit(train)
    good = F.avg((F.col("prediction") == F.col("label")).cast("double")) if classify else -F.avg((F.col("prediction") - F.col("label")) ** 2)
    a, b = (m.transform(test).agg(good).first()[0] for m in (ours, spark_ml))
    assert a >= b - (0.02 if classify else 0.25 * abs(b))
    assert np.allclose(ours.featureImportances.toArray(), spark_ml.featureImportances.toArray(), atol=0.1)
    assert ours.getNumTrees == 30 and ours.numFeatures == 3


def test_one_tree_splits_as_a_plain_search_does():
    rng = np.random.default_rng(0)
    n, s = 400, fo.Shape(2, 2, 8, 0, 1, 0)
    bins, y = rng.integers(0, 8, (2, n)).astype(np.uint8), rng.normal(size=n)
    counts = s.counts(1)
    fo.add_up(s, counts, bins.ravel(), n, np.arange(n), np.zeros(n, int), 0, fo.choices(s, 0, 0, 1), [np.ones(n), y, y * y])
    got = fo.best_splits(s, counts.reshape(1, 2, 8, 3), fo.choices(s, 0, 0, 1))
    best = max(((y.var() - sum(len(p) * p.var() for p in (y[bins[f] <= b], y[bins[f] > b])) / n, f, b)
                for f in range(2) for b in range(7)))
    assert (got[0][0], got[1][0]) == best[1:] and np.isclose(got[2][0], best[0])


def test_bags_are_poisson():
    w = np.concatenate([fo.bag(42, (7, k), t, 50_000) for k in range(3) for t in range(4)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005


def test_odd_rows(spark):
    one = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.range(50).select(F.lit(1.0).alias("x"), (F.col("id") % 2).cast("double").alias("label")))
    m = fo.Forest(True, 3, 4, 1).fit(one)                       # a feature without a split
    assert m.totalNumNodes == 3
    assert fo.Forest(False, 3, 4, 1).fit(one).transform(one).select("prediction").distinct().count() == 1
    with pytest.raises(ValueError, match="no rows"):
        fo.Forest(True, 3, 4, 1).fit(one.limit(0))


def test_a_fit_caches_about_a_byte_a_feature(spark, monkeypatch):
    """What is kept of a row while a forest is fitted: a byte a feature and the label, whatever the trees."""
    seen, packer = [], fo._packer
    monkeypatch.setattr(fo, "_packer", lambda *a: seen.append(packer(*a)) or seen[-1])
    df = _rows(spark).withColumn("label", F.col("c"))
    fo.Forest(True, 100, 3, 1).fit(df)
    x = df.select(F.array("x", "y", "z").alias("x"), "label")
    blocks = x.mapInArrow(seen[0][0], fo.BLOCKS)
    got = blocks.agg(F.sum("n"), F.sum(F.length("bins") + F.length("labels"))).first()
    assert got[0] == 6000 and got[1] == 6000 * 4


def test_folds_need_no_shuffle_of_rows(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("id"), (F.col("id") % 3).cast("double").alias("label"))
    out = ml.stratified_folds(df, "label", "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    rows = out.collect()
    for c in range(3):
        mine = sorted((r["id"], r["fold"]) for r in rows if r["label"] == c)
        folds = [f for _, f in mine]
        assert folds == sorted(folds)
        sizes = np.bincount(folds, minlength=3)
        assert sizes.sum() == len(mine) and sizes.max() - sizes.min() <= 1


def test_rows_of_one_key_are_shared_among_folds(spark):
    df = spark.range(90).select((F.col("id") % 4).alias("id"), F.lit("a").alias("label"))
    rows = ml.stratified_folds(df, "label", "id").collect()
    assert np.bincount([r["fold"] for r in rows]).tolist() == [30, 30, 30]
    mine = sorted((r["id"], r["fold"]) for r in rows)
    assert [f for _, f in mine] == sorted(f for _, f in mine)
