"""A fit that fails is an error of the whole run, never a row that looks like a result."""

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import automl as ml
from tabsmith.plans import ml_queries as q


class Broken:
    def __init__(self, estimator, fails_at):
        self.estimator, self.fails_at = estimator, fails_at

    def fit(self, rows):
        if self.fails_at(rows):
            raise OSError("No space left on device")
        return self.estimator.fit(rows)


@pytest.fixture
def broken(monkeypatch):
    make = ml.make_estimator

    def use(model, fails_at=lambda rows: True):
        monkeypatch.setattr(ml, "make_estimator", lambda name, *a: Broken(make(name, *a), fails_at) if name == model
                            else make(name, *a))
    return use


def _frame(spark, classes):
    x = F.col("id") % 37
    return spark.range(300).select("id", x.cast("double").alias("x"), (F.when(x > 18, "hi").otherwise("lo") if classes
                                                                       else x * 3.0).alias("y"))


def test_a_failing_fit_is_raised(spark, broken):
    broken("Random Forest Regressor")
    with pytest.raises(RuntimeError, match="Random Forest Regressor failed: No space left"):
        ml.auto_train(_frame(spark, False), "y", split_key=F.col("id"), ids=("id",), forest_depth=2)


def test_a_failing_fold_is_raised(spark, broken):
    broken("Logistic Regression", lambda rows: rows.count() < 200)          # the folds' rows, not the final fit's 240
    with pytest.raises(RuntimeError, match="Logistic Regression, fold 0, failed: No space left"):
        ml.auto_train(_frame(spark, True), "y", split_key=F.col("id"), ids=("id",), forest_depth=2)


def test_the_query_gives_no_row_for_a_failed_model(spark, broken, monkeypatch):
    broken("Random Forest Regressor")
    monkeypatch.setattr(q, "_RUNS", {})
    with pytest.raises(RuntimeError, match="No space left"):
        q.q_random_forest_regressor(spark, "/root/testdata/sf0.001")


def test_failures_are_reported_when_asked_for(spark, broken):
    broken("Random Forest Regressor")
    r = ml.auto_train(_frame(spark, False), "y", split_key=F.col("id"), ids=("id",), report_failures=True)
    assert [s.error for s in r.scores] == [None, "No space left on device"] and r.best.model == "Linear Regression"
