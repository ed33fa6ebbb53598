"""Training rows are dealt out, and small tables are broadcast, whatever files and keys look like."""

from pyspark.sql import functions as F

from tabsmith.operators import automl as ml


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Final Plan ==")[-1]


def test_label_codes_are_broadcast(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id") % 3)).alias("c"))
    out = ml.label_encode(df, ["c"])
    plan = _plan(out)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r["id"] % 3, r["c"]) for r in out.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_fold_ends_are_broadcast(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("double").alias("label"))
    plan = _plan(ml.stratified_folds(df, "label", "id"))
    assert "BroadcastHashJoin" in plan
    assert not any("hashpartitioning(label" in line and "_pb" not in line for line in plan.splitlines())


def test_rows_of_one_partition_are_dealt_out_to_fit(spark, monkeypatch):
    monkeypatch.setattr(ml, "ROWS_PER_FIT_PARTITION", 100)
    seen = {}
    make = ml.make_estimator

    class Spy:
        def __init__(self, name, n_train, depth):
            self.name, self.estimator = name, make(name, n_train, depth)

        def fit(self, rows):
            seen.setdefault(self.name, []).append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
            return self.estimator.fit(rows)

    monkeypatch.setattr(ml, "make_estimator", Spy)
    df = spark.range(2000).select("id", (F.col("id") % 50).alias("x"), F.when(F.col("id") % 50 > 20, "hi").otherwise("lo")
                                  .alias("y")).coalesce(1)
    result = ml.auto_train(df, "y", split_key=F.col("id"), ids=("id",), forest_depth=3)
    assert result.n_train == 1600 and result.best.value > 0.9
    for name in ml.MODELS[ml.CLASSIFICATION]:
        assert len(seen[name]) == 4
        for rows in seen[name]:
            assert len(rows) >= 20 and max(rows) <= 100
