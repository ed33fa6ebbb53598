"""Registered machine-learning queries (ML1-ML21) over the F4 frames.

Preparation steps, the split, scaling, one-feature least squares with its
metrics and bands, and the fold assignment are exact and SQL-checkable.
Model fits (logistic regression, forests, the AutoML run) are checked by
rows only; one fitted run per (session, input) is shared by the queries
that report on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.columns import round_doubles
from tabsmith.operators import automl as ml
from tabsmith.sources import fixtures as fx
from tabsmith.sources.tables import load_table

# FIXED VALUES: the split rule of the F4 frames (FIXTURES.md)
def LINEITEM_SPLIT_KEY():
    return F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729


def EVENTS_SPLIT_KEY():
    return F.col("event_id") * 7919


def FOLD_KEY():
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")

DIRTY_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus"]
TASK_TARGETS = [("lineitem", "l_returnflag"), ("lineitem", "l_quantity"),
                ("lineitem", "l_linenumber"), ("part", "p_size"), ("events", "value")]
OLS_FEATURES = ["l_quantity", "l_discount"]


def q_resolve_target(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.query_log(spark, sf)
    return log.select("conv_id", "turn",
                      ml.resolve_target_expr(F.col("query"), DIRTY_COLUMNS).alias("target"))


def q_detect_task_type(spark, sf):
    parts = [ml.detect_task_type(load_table(spark, sf, t), c).withColumn("source", F.lit(t))
             for t, c in TASK_TARGETS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_drop_unlabelled(spark, sf):
    return round_doubles(ml.drop_unlabelled(fx.dirty_lineitem(spark, sf), "l_returnflag"))


def q_label_encode(spark, sf):
    return round_doubles(ml.label_encode(fx.dirty_lineitem(spark, sf),
                                         ["l_returnflag", "l_linestatus"]))


def q_impute_features_mean(spark, sf):
    base = ml.drop_unlabelled(fx.dirty_lineitem(spark, sf), "l_returnflag")
    return round_doubles(ml.impute_features_mean(base, ml.feature_columns(base, "l_returnflag")))


def _split_reg(spark, sf):
    return fx.ml_reg_linear(spark, sf).withColumn("split", ml.split_expr(LINEITEM_SPLIT_KEY()))


def q_split(spark, sf):
    return _split_reg(spark, sf).select("l_orderkey", "l_linenumber", "split")


def q_scale(spark, sf):
    d = _split_reg(spark, sf)
    stats = ml.scale_stats(d.filter(F.col("split") == "train"), OLS_FEATURES)
    return round_doubles(ml.scale(d, stats).select("l_orderkey", "l_linenumber", "split",
                                                   *OLS_FEATURES))


def _ols(spark, sf):
    """One-feature least squares fitted on train (ML11 single-feature form)."""
    d = _split_reg(spark, sf)
    tr = d.filter(F.col("split") == "train")
    aggs = []
    for i, f in enumerate(OLS_FEATURES):
        aggs += [F.regr_slope("y", f).alias(f"b{i}"), F.regr_intercept("y", f).alias(f"a{i}"),
                 F.regr_r2("y", f).alias(f"r{i}")]
    row = tr.agg(*aggs).first()
    return d, {f: (row[f"b{i}"], row[f"a{i}"], row[f"r{i}"]) for i, f in enumerate(OLS_FEATURES)}


def q_linear_regression(spark, sf):
    _, coef = _ols(spark, sf)
    rows = [(f, b, a, r) for f, (b, a, r) in coef.items()]
    return round_doubles(spark.createDataFrame(
        rows, "feature string, slope double, intercept double, r2_train double"))


def _ols_metrics(spark, sf):
    d, coef = _ols(spark, sf)
    te = d.filter(F.col("split") == "test")
    parts = []
    for f, (b, a, _) in coef.items():
        pred = te.select(F.col("y").alias("label"),
                         (F.lit(a) + F.lit(b) * F.col(f)).alias("prediction"))
        parts.append(ml.regression_metrics(pred).withColumn("feature", F.lit(f)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_regression_metrics(spark, sf):
    return round_doubles(_ols_metrics(spark, sf))


def q_interpretation_band(spark, sf):
    m = _ols_metrics(spark, sf)
    return round_doubles(m.select("feature", "r2", ml.interpretation_band(
        F.col("r2"), F.lit(ml.REGRESSION)).alias("band")))


def q_cross_validate(spark, sf):
    li = load_table(spark, sf, "lineitem")
    tr = (li.withColumn("split", ml.split_expr(LINEITEM_SPLIT_KEY())).filter(F.col("split") == "train")
            .select(FOLD_KEY().alias("k"), F.col("l_returnflag").alias("label")))
    return ml.stratified_folds(tr, "label", "k", ml.CV_FOLDS).select("k", "label", "fold")


# ------------------------------------------------------------- model fits

_RUNS: dict = {}


def _run(spark, sf, name):
    key = (id(spark), sf, name)
    if key not in _RUNS:
        if name == "class_rule":
            df = fx.ml_class_rule(spark, sf)
            _RUNS[key] = ml.auto_train(df, "level", split_key=EVENTS_SPLIT_KEY(),
                                       ids=("event_id",))
        elif name == "labels":
            _RUNS[key] = ml.auto_train(fx.labels_join(spark, sf).drop("doc_id"), "quality",
                                       split_key=None)
        elif name == "reg_linear":
            df = fx.ml_reg_linear(spark, sf)
            _RUNS[key] = ml.auto_train(df, "y", split_key=LINEITEM_SPLIT_KEY(),
                                       ids=("l_orderkey", "l_linenumber"))
    return _RUNS[key]


def _model_row(result, model_name):
    s = next(x for x in result.scores if x.model == model_name)
    return s


def q_logistic_regression(spark, sf):
    s = _model_row(_run(spark, sf, "class_rule"), "Logistic Regression")
    return spark.createDataFrame([(s.model, s.value, s.cv_mean, s.cv_std)],
                                 "model string, accuracy double, cv_mean double, cv_std double")


def q_random_forest_classifier(spark, sf):
    s = _model_row(_run(spark, sf, "class_rule"), "Random Forest")
    return spark.createDataFrame([(s.model, s.value, s.cv_mean, s.cv_std)],
                                 "model string, accuracy double, cv_mean double, cv_std double")


def q_random_forest_regressor(spark, sf):
    s = _model_row(_run(spark, sf, "reg_linear"), "Random Forest Regressor")
    return spark.createDataFrame([(s.model, s.value, s.extra.get("rmse"), s.extra.get("mae"))],
                                 "model string, r2 double, rmse double, mae double")


def q_accuracy(spark, sf):
    r = _run(spark, sf, "class_rule")
    return spark.createDataFrame([(s.model, s.value) for s in r.scores],
                                 "model string, accuracy double")


def q_feature_importance(spark, sf):
    return ml.importance_frame(_run(spark, sf, "class_rule"))


def q_leaderboard(spark, sf):
    return ml.leaderboard(_run(spark, sf, "class_rule"))


def q_best_model(spark, sf):
    return ml.best_model(ml.leaderboard(_run(spark, sf, "reg_linear")))


def q_auto_train(spark, sf):
    return ml.leaderboard(_run(spark, sf, "labels"))


def _classes_run(target):
    """ML19 on a numeric target that is not 0 to k - 1: both models are scored on all rows."""
    def q(spark, sf):
        df = fx.events(spark, sf).select("event_id", "value", "user_id", target().alias("target"))
        r = ml.auto_train(df, "target", split_key=EVENTS_SPLIT_KEY(), ids=("event_id",), cv=False)
        good = [s.value is not None and s.value > 0.5 for s in r.scores]
        return spark.createDataFrame(
            [(s.model, ok, len(r.classes), float(r.classes[0]), float(r.classes[-1]), r.n_train, r.n_test)
             for s, ok in zip(r.scores, good)],
            "model string, scored boolean, n_classes bigint, lowest double, highest double, n_train bigint, n_test bigint")
    return q


def _signs():
    return F.when(F.col("value") > 50, 1).otherwise(-1)


def _years():
    return F.lit(2019) + (F.col("value") > 30).cast("int") + (F.col("value") > 60).cast("int")


def _fractions():
    return F.when(F.col("value") > 50, 1.5).otherwise(0.5)


def q_accuracy_of_rule(spark, sf):
    """ML13 on predictions that need no model: the decade of a value shifted by three."""
    pred = fx.events(spark, sf).filter("value IS NOT NULL").select(
        F.floor(F.col("value") / 10).alias("label"), F.floor((F.col("value") + 3) / 10).alias("prediction"))
    return round_doubles(ml.accuracy(pred))


def q_best_of_types(spark, sf):
    """ML17's choice on a board that needs no model: event types by their mean value."""
    from pyspark.sql import Window
    board = fx.events(spark, sf).groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("value"))
    board = round_doubles(board).withColumn("ordinal", F.dense_rank().over(Window.orderBy("model")).cast("bigint"))
    return ml.best_model(board).select("ordinal", "model", "value")


def q_model_result(spark, sf):
    return ml.model_result(_run(spark, sf, "class_rule"))


def q_select_features(spark, sf):
    prepared, feats = ml.prepare(fx.dirty_lineitem(spark, sf), "l_returnflag")
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(feats)],
                                 "ordinal bigint, feature string")


def q_predict(spark, sf):
    """ML21: the best model's predictions for every raw event, by the saved
    and reloaded model."""
    from tabsmith.session import scratch_path
    path = ml.save_pipeline(_run(spark, sf, "class_rule"), scratch_path(spark, "model"), spark)
    pred = ml.load_pipeline(spark, path).predict(fx.ml_class_rule(spark, sf))
    return pred.select("event_id", F.col("level").alias("label"), F.col("predicted_class").alias("prediction"))


def q_insight_with_model(spark, sf):
    """QL13 with a trained model: the advice for the AutoML result."""
    res = ml.model_result(_run(spark, sf, "class_rule"))
    from tabsmith.operators.querylog import insight_text
    return res.select(insight_text(F.col("task"), F.col("best_model"), F.col("best_metric"),
                                   F.col("top_features"), F.lit("")).alias("insight"),
                      _band())


def _band():
    return ml.interpretation_band(F.col("best_metric"), F.col("task")).alias("band")


def q_impute_features_train_only(spark, sf):
    """ML5 without leakage: fill means from the train split of the rows."""
    base = ml.drop_unlabelled(fx.dirty_lineitem(spark, sf), "l_returnflag")
    on = ml.split_expr(LINEITEM_SPLIT_KEY()) == "train"
    return round_doubles(ml.impute_features_mean(base, ml.feature_columns(base, "l_returnflag"),
                                                 fit_on=on))


def ml_queries() -> dict:
    return {
        "resolve_target": q_resolve_target,
        "detect_task_type": q_detect_task_type,
        "drop_unlabelled": q_drop_unlabelled,
        "label_encode": q_label_encode,
        "impute_features_mean": q_impute_features_mean,
        "impute_features_train_only": q_impute_features_train_only,
        "select_features": q_select_features,
        "split": q_split,
        "scale": q_scale,
        "linear_regression": q_linear_regression,
        "regression_metrics": q_regression_metrics,
        "interpretation_band": q_interpretation_band,
        "cross_validate": q_cross_validate,
        "logistic_regression": q_logistic_regression,
        "random_forest_classifier": q_random_forest_classifier,
        "random_forest_regressor": q_random_forest_regressor,
        "accuracy": q_accuracy,
        "feature_importance": q_feature_importance,
        "leaderboard": q_leaderboard,
        "best_model": q_best_model,
        "auto_train": q_auto_train,
        "auto_train_signs": _classes_run(_signs),
        "auto_train_years": _classes_run(_years),
        "auto_train_fractions": _classes_run(_fractions),
        "accuracy_of_rule": q_accuracy_of_rule,
        "best_of_types": q_best_of_types,
        "model_result": q_model_result,
        "predict": q_predict,
        "insight_with_model": q_insight_with_model,
    }

