"""AutoML (ML1-ML21): task detection, preparation, deterministic split,
scaling, model training, metrics, folds, leaderboard.

Preparation steps are plain DataFrame expressions (so each has an exact SQL
form); fitting uses Spark ML's linear estimators and the forests of ``forest``. Statistics that parameterise a step
(feature means, train mean / std) are one aggregate each, applied as literals.
"""

from __future__ import annotations

import json
import math
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import (LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassificationModel)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import rules as R
from tabsmith.functions.columns import (CATEGORICAL, NUMERIC, as_double, col, column_class,
                                        columns_info)
from tabsmith.functions.positions import key_blocks
from tabsmith.functions.ranking import dense_codes
from tabsmith.operators.forest import Forest
from tabsmith.session import save_once

CLASSIFICATION, REGRESSION = "classification", "regression"
MAX_CLASSES_DISCRETE = 20     # nunique <= 20 -> classification
TRAIN_PCT = 80
FOREST_TREES = 100
FOREST_DEPTH = 10             # default of auto_train(forest_depth=); Spark allows up to 30
LOGISTIC_MAX_ITER = 1000
CV_FOLDS = 3
SEED = 42
FIT_THREADS = 4               # concurrent fits (final + CV folds)


# ----------------------------------------------------------- target / task

def target_hint_expr(query: Column) -> Column:
    """ML1 (log form): the word after ``target:`` in a query, lower-cased,
    trailing . , ; removed; NULL when absent."""
    ws = R.PY_WHITESPACE
    raw = F.regexp_extract(F.lower(query), f"target:[{ws}]*([^{ws}]+)", 1)
    word = F.regexp_replace(raw, "[.,;]+$", "")
    return F.when(word != "", word)


def resolve_target_expr(query: Column, columns: list[str]) -> Column:
    """ML1: the column named after ``target:`` (case-insensitive), else the
    last column."""
    hint = target_hint_expr(query)
    pick = None
    for c in columns:
        cond = hint == c.lower()
        pick = F.when(cond, c) if pick is None else pick.when(cond, c)
    return F.coalesce(pick, F.lit(columns[-1])) if pick is not None else F.lit(columns[-1])


def resolve_target(df: DataFrame, hint: str | None = None) -> str:
    """ML1 on a plain parameter (driver side, no job)."""
    if hint:
        for c in df.columns:
            if c.lower() == hint.strip().lower().rstrip(".,;"):
                return c
    return df.columns[-1]


def detect_task_type(df: DataFrame, target: str) -> DataFrame:
    """ML2: (target, dtype, unique, task, reason) -- categorical target or at
    most 20 distinct values -> classification, else regression."""
    dt = df.schema[target].dataType
    is_cat = column_class(dt) == CATEGORICAL
    u = F.count_distinct(col(target)).cast("bigint")
    one = df.agg(u.alias("unique"))
    task = (F.lit(CLASSIFICATION) if is_cat else
            F.when(F.col("unique") <= MAX_CLASSES_DISCRETE, CLASSIFICATION).otherwise(REGRESSION))
    reason = (F.lit("String/category column → classification") if is_cat else
              F.format_string("%d unique numeric values → %s", F.col("unique"), task))
    return one.select(F.lit(target).alias("target"), F.lit(dt.simpleString()).alias("dtype"),
                      "unique", task.alias("task"), reason.alias("reason"))


def task_of(df: DataFrame, target: str) -> str:
    """The task alone: whether there are more than 20 distinct values takes no
    count of them all (a bounded ``distinct().limit``)."""
    if column_class(df.schema[target].dataType) == CATEGORICAL:
        return CLASSIFICATION
    some = (df.select(col(target)).filter(col(target).isNotNull()).distinct()
              .limit(MAX_CLASSES_DISCRETE + 1).count())
    return CLASSIFICATION if some <= MAX_CLASSES_DISCRETE else REGRESSION


def class_values(df: DataFrame, target: str) -> list:
    """The classes of a classification target in label order (text order for
    categories, numeric order for numbers). They are part of the model, which
    holds coefficients or leaf counts for each of them anyway."""
    if column_class(df.schema[target].dataType) == CATEGORICAL:
        return [r["value"] for r in label_codes(df, target).orderBy("code").collect()]
    return sorted(r[0] for r in df.select(as_double(target)).distinct().collect())


def index_label(df: DataFrame, target: str, classes: list) -> DataFrame:
    """A numeric classification target replaced by its place among ``classes``
    (0 to k - 1), as the classifiers want it."""
    code = F.create_map(*[F.lit(x) for i, v in enumerate(classes) for x in (float(v), float(i))])
    return df.withColumn(target, F.element_at(code, as_double(target)))


def drop_unlabelled(df: DataFrame, target: str) -> DataFrame:
    """ML3: rows with a missing target are dropped."""
    return df.filter(col(target).isNotNull())


# ------------------------------------------------------------- preparation

SMALL_CODES = 10_000


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code) of ``column`` as text with missing as "nan", codes in
    sorted text order. A bounded probe (``distinct().limit``) decides: at most
    ``SMALL_CODES`` values are coded on the driver (binary string order, as
    Spark sorts); more use the distributed dense rank (no global window)."""
    text = F.coalesce(col(column).cast("string"), F.lit("nan"))
    values = df.select(text.alias("value"))
    probe = values.distinct().limit(SMALL_CODES + 1).collect()
    if len(probe) <= SMALL_CODES:
        ordered = sorted((r["value"] for r in probe), key=lambda v: v.encode("utf-8"))
        codes = df.sparkSession.createDataFrame(list(zip(ordered, range(len(ordered)))),
                                                "value string, code bigint")
        return F.broadcast(codes)       # Spark can't know its size: a shuffle would bring a value's rows to one task
    return dense_codes(values, "value")


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """ML4: each listed column replaced by its code (bigint). A code table of at
    most ``SMALL_CODES`` values is broadcast; otherwise a shuffle join (AQE
    splits skewed values)."""
    out = df
    for c in columns:
        codes = label_codes(df, c).select(F.col("value").alias("__v"), F.col("code").alias("__code"))
        key = F.coalesce(col(c).cast("string"), F.lit("nan"))
        out = (out.withColumn("__v", key).join(codes, "__v", "left")
                  .withColumn(c, F.col("__code")).drop("__v", "__code"))
    return out


def feature_columns(df: DataFrame, target: str, ids: tuple = ()) -> list[str]:
    """ML6: numeric columns other than the target and id columns (booleans,
    dates, arrays are not features)."""
    return [c.name for c in columns_info(df)
            if c.cls == NUMERIC and c.name != target and c.name not in ids]


def prepare(df: DataFrame, target: str, ids: tuple = (),
            impute_on: Column | None = None) -> tuple[DataFrame, list[str]]:
    """ML3 + ML4 + ML5: drop unlabelled rows, encode categorical features and
    a categorical target, fill numeric features with their mean -- over the
    whole labelled set (the reference's order, before splitting), or over the
    rows where ``impute_on`` holds (e.g. the train split, no leakage)."""
    base = drop_unlabelled(df, target)
    cats = [c.name for c in columns_info(base) if c.cls == CATEGORICAL and c.name not in ids]
    enc = label_encode(base, cats) if cats else base
    feats = feature_columns(enc, target, ids)
    return impute_features_mean(enc, feats, fit_on=impute_on), feats


def impute_features_mean(df: DataFrame, features: list[str],
                         fit_on: Column | None = None) -> DataFrame:
    """ML5: missing feature values -> the feature mean (one aggregate), taken
    over all rows or over the rows where ``fit_on`` holds."""
    if not features:
        return df
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(features):
        x = as_double(f) if fit_on is None else F.when(fit_on, as_double(f))
        aggs += [F.avg(x).alias(f"m{i}"), F.count(col(f)).alias(f"n{i}")]
    row = df.agg(*aggs).collect()[0]
    # only columns with a gap change (and become double); all-missing stays missing
    fill = {f: row[f"m{i}"] for i, f in enumerate(features)
            if row[f"m{i}"] is not None and row[f"n{i}"] < row["rows"]}
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in fill:
            c = F.coalesce(c.cast("double"), F.lit(fill[f.name]))
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def split_expr(key: Column, train_pct: int = TRAIN_PCT) -> Column:
    """ML7: deterministic split from an integral key: pmod(key, 100) < 80 -> train."""
    return F.when(F.pmod(key, F.lit(100)) < train_pct, "train").otherwise("test")


def random_split_expr(seed: int = SEED, train_pct: int = TRAIN_PCT) -> Column:
    """ML7 option: a seeded random 80/20 split (like ``randomSplit``). The
    draw depends on the input partitioning, so persist the tagged frame if it
    is used more than once; the hash split (``split_expr``) has no such caveat."""
    return F.when(F.rand(seed) < train_pct / 100.0, "train").otherwise("test")


def row_key(df: DataFrame) -> Column:
    """Default split key: a 64-bit hash of the whole row."""
    return F.xxhash64(*[col(c) for c in df.columns])


def scale_stats(train: DataFrame, features: list[str]) -> dict:
    """ML8 fit: mean and population std per feature on the train rows."""
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(as_double(f)).alias(f"m{i}"), F.stddev_pop(as_double(f)).alias(f"s{i}")]
    row = train.agg(*aggs).collect()[0]
    return {f: (row[f"m{i}"], row[f"s{i}"]) for i, f in enumerate(features)}


@dataclass
class Preparation:
    """ML3-ML8 fitted: all that turns raw rows into a model's rows.

    ``codes`` holds (feature, value, code) of the categorical features, ``numbers``
    per feature (fill, mean, std). Applied to any rows: a missing category is the
    category "nan"; a category that fitting did not see, and a missing or NaN
    number, get the feature's fill; a feature without any known value is 0 after scaling."""
    target: str
    task: str
    features: list[str]
    categorical: list[str]
    numbers: dict
    codes: DataFrame | None = None
    classes: list | None = None

    def feature_vector(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` of the rows' columns and their scaled ``features``."""
        return self.assemble(self.scaled(df, keep))

    def scaled(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` of the rows' columns and a column ``__f0``, ``__f1``, ... for each scaled feature."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"Columns not found: {', '.join(missing)}")
        out = df
        for i, f in enumerate(self.categorical):
            codes = self.codes.filter(F.col("feature") == f).select(F.col("value").alias(f"__v{i}"),
                                                                    F.col("code").alias(f"__c{i}"))
            out = out.withColumn(f"__v{i}", F.coalesce(col(f).cast("string"), F.lit("nan")))
            out = out.join(codes, f"__v{i}", "left")
        scaled = []
        for i, f in enumerate(self.features):
            x = F.col(f"__c{self.categorical.index(f)}") if f in self.categorical else as_double(f)
            fill, mean, std = self.numbers[f]
            x = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
            x = (F.coalesce(x, F.lit(fill).cast("double")) - F.lit(mean or 0.0)) / F.lit(std or 1.0)
            scaled.append(F.coalesce(x, F.lit(0.0)).alias(f"__f{i}"))
        return out.select(*[col(c) for c in keep], *scaled)

    def assemble(self, scaled: DataFrame) -> DataFrame:
        """The columns of ``scaled`` as the vector ``features``."""
        va = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(self.features))], outputCol="features",
                             handleInvalid="keep")
        return va.transform(scaled).drop(*[f"__f{i}" for i in range(len(self.features))])

    def label(self, df: DataFrame) -> Column:
        """The target as the models take it: the place of a class, or the number."""
        if self.classes is None:
            return as_double(self.target)
        text = column_class(df.schema[self.target].dataType) == CATEGORICAL
        value = col(self.target).cast("string") if text else as_double(self.target)
        places = F.create_map(*[F.lit(x) for i, v in enumerate(self.classes) for x in (v, float(i))])
        return F.element_at(places, value)

    def save(self, path: str, spark) -> None:
        """Written as one row of JSON and the table of codes."""
        facts = {k: getattr(self, k) for k in ("target", "task", "features", "categorical", "numbers", "classes")}
        spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").parquet(
            os.path.join(path, "facts"))
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(os.path.join(path, "codes"))

    @staticmethod
    def load(path: str, spark) -> Preparation:
        facts = json.loads(spark.read.parquet(os.path.join(path, "facts")).first()["facts"])
        codes = spark.read.parquet(os.path.join(path, "codes")) if facts["categorical"] else None
        return Preparation(codes=codes, **facts)


def fit_preparation(df: DataFrame, target: str, task: str, on_train: Column, ids: tuple = (),
                    impute_on: str = "train") -> tuple[Preparation, int]:
    """(the preparation fitted to labelled rows, their number). Fills are the
    means of the train rows (``impute_on="train"``, so nothing of the test rows
    reaches the models) or of all rows ("all"); scaling is always fitted on the
    filled train rows. One aggregate: the moments after filling follow from
    those of the known values, so the rows are not read again."""
    cats = [c.name for c in columns_info(df) if c.cls == CATEGORICAL and c.name not in ids and c.name != target]
    order = [c.name for c in columns_info(df) if c.cls in (CATEGORICAL, NUMERIC)
             and c.name != target and c.name not in ids]
    codes, out = None, df.withColumn("__on", on_train)
    for i, f in enumerate(cats):
        one = label_codes(df, f).select(F.lit(f).alias("feature"), "value", "code")
        codes = one if codes is None else codes.unionByName(one)
    if codes is not None:
        codes = save_once(codes, "label-codes")     # coded once for fitting, every fold, and scoring
    for i, f in enumerate(cats):
        mine = codes.filter(F.col("feature") == f).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
        out = (out.withColumn(f"__v{i}", F.coalesce(col(f).cast("string"), F.lit("nan")))
                  .join(mine, f"__v{i}", "left"))
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__on")).alias("train")]
    for i, f in enumerate(order):
        x = F.col(f"__c{cats.index(f)}").cast("double") if f in cats else as_double(f)
        x = F.nanvl(x, F.lit(None).cast("double"))
        t = F.when(F.col("__on"), x)
        aggs += [F.avg(x).alias(f"a{i}"), F.avg(t).alias(f"m{i}"), F.var_pop(t).alias(f"v{i}"),
                 F.count(t).alias(f"n{i}")]
    row = out.agg(*aggs).first()
    numbers, total = {}, row["train"]
    for i, f in enumerate(order):
        mean, var, n = row[f"m{i}"], row[f"v{i}"], row[f"n{i}"]
        fill = mean if impute_on == "train" else row[f"a{i}"]
        if not n:                       # no known train value: every train row holds the fill
            numbers[f] = (fill, fill, 0.0)
            continue
        gap = (total - n) / total
        m = (1 - gap) * mean + gap * fill
        v = (1 - gap) * (var + (mean - m) ** 2) + gap * (fill - m) ** 2
        numbers[f] = (fill, m, math.sqrt(v))
    return Preparation(target, task, order, cats, numbers, codes), row["rows"]


ROWS_PER_FIT_PARTITION = 200_000        # a forest packs as many into a block


def fit_partitions(spark, n_rows: int) -> int:
    """Partitions for model fitting: the cluster's parallelism, more when
    the rows would exceed ``ROWS_PER_FIT_PARTITION`` per partition."""
    return max(spark.sparkContext.defaultParallelism,
               math.ceil((n_rows or 0) / ROWS_PER_FIT_PARTITION), 1)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """The rows to fit on in ``parts`` even partitions: as read they may lie in one task (a file's row group), and
    a persisted plan keeps its partitioning. Rows alike lie together: scoring them walks the same nodes of a forest,
    not ones all over its memory."""
    near = [c for c in rows.columns if c.startswith("__f")]
    return rows.repartition(parts).sortWithinPartitions(*near, "__kid").drop("__kid")


def scale(df: DataFrame, stats: dict) -> DataFrame:
    """ML8 apply: (x - mean) / std, a zero std counts as 1."""
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in stats:
            m, s = stats[f.name]
            s = 1.0 if not s else s
            c = (as_double(f.name) - F.lit(m if m is not None else 0.0)) / F.lit(s)
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


# ------------------------------------------------------------------ models

def make_estimator(name: str, n_train: int, forest_depth: int = FOREST_DEPTH):
    """ML9-ML12: the four estimators with the reference's settings."""
    if name == "Logistic Regression":
        return LogisticRegression(maxIter=LOGISTIC_MAX_ITER, regParam=1.0 / max(1, n_train),
                                  elasticNetParam=0.0, standardization=False)
    if name == "Random Forest":
        return Forest(True, FOREST_TREES, forest_depth, SEED)
    if name == "Linear Regression":
        return LinearRegression(regParam=0.0, solver="normal", standardization=False)
    if name == "Random Forest Regressor":
        return Forest(False, FOREST_TREES, forest_depth, SEED)
    raise ValueError(name)


MODELS = {CLASSIFICATION: ["Logistic Regression", "Random Forest"],
          REGRESSION: ["Linear Regression", "Random Forest Regressor"]}


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """ML13: share of correct predictions."""
    return pred.agg(F.avg((col(prediction) == col(label)).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).cast("bigint").alias("n"))


def regression_metrics(pred: DataFrame, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """ML14: RMSE, MAE, R² (1 - SSE / SST around the evaluated rows' mean)."""
    e = as_double(prediction) - as_double(label)
    stats = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                     F.sum(e * e).alias("sse"), F.var_pop(as_double(label)).alias("vp"),
                     F.count(F.lit(1)).alias("n"))
    return stats.select(F.sqrt("mse").alias("rmse"), "mae",
                        (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("vp") * F.col("n"))).alias("r2"),
                        F.col("n").cast("bigint").alias("n"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = CV_FOLDS) -> DataFrame:
    """ML15 folds: per class, rows in key order are cut into k contiguous
    blocks whose sizes follow the unshuffled stratified rule (the class's
    share of every k-th position of the label-sorted order). Only the keys at
    which folds end are looked for (``fold_ends``); rows are not sorted or moved."""
    keyed = df.filter(col(label).isNotNull() & col(key).isNotNull())
    return with_folds(keyed, label, key, fold_ends(df, label, key, k))


def fold_ends(df: DataFrame, label: str, key: str, k: int = CV_FOLDS) -> list[tuple]:
    """Where the folds of each class end: (class, [(key, rows with just this key that the fold still takes), ...]).
    The counts of blocks of keys (``functions.positions``) tell in which block an end lies, and only the rows of
    these blocks are put in order."""
    kept = df.select(col(label).alias("c"), col(key).cast("bigint").alias("k")).filter("c IS NOT NULL AND k IS NOT NULL")
    counts = sorted((r["c"], r["n"]) for r in kept.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect())
    wanted, start = [], 0
    for c, n in counts:
        cum = 0
        for a in _alloc(start, n, k):
            cum += a
            wanted.append((c, cum))
        start += n
    if not wanted:
        return []
    spark, dt = df.sparkSession, df.schema[label].dataType
    wanted = spark.createDataFrame(sorted(set(wanted)), T.StructType([T.StructField("c", dt), T.StructField("e", T.LongType())]))
    blocks = key_blocks(kept, "k")
    sizes = blocks.groupBy("c", "_pb").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    ends = (sizes.withColumn("before", before).join(F.broadcast(wanted), "c")
                 .filter("e > before AND e <= before + n").select("c", "_pb", "before", "e"))
    ends = spark.createDataFrame(ends.collect(), ends.schema)
    near = (blocks.join(F.broadcast(ends.select("c", "_pb", "before").distinct()), ["c", "_pb"])
                  .groupBy("c", "_pb", "before", "k").agg(F.count(F.lit(1)).alias("same")))
    upto = F.sum("same").over(Window.partitionBy("c", "_pb").orderBy("k"))
    found = (near.withColumn("upto", F.col("before") + upto).join(F.broadcast(ends.select("c", "e")), "c")
                 .filter("e <= upto AND e > upto - same").select("c", "e", "k", (F.col("e") - F.col("upto") + F.col("same")).alias("m"),
                                                                 "same"))
    at = {(r["c"], r["e"]): (r["k"], r["m"] if r["m"] < r["same"] else None) for r in found.collect()}
    out, start = [], 0
    for c, n in counts:
        cum, mine = 0, []
        for a in _alloc(start, n, k):
            cum += a
            mine.append((None, None) if cum == 0 else at[(c, cum)])
        out.append((c, mine))
        start += n
    return out


def with_folds(df: DataFrame, label: str, key: str, ends: list[tuple]) -> DataFrame:
    """Each row with its ``fold`` by where the folds of its class end (null: a class without ends). Rows that share the
    key at which a fold ends are numbered, so that each fold gets its share of them."""
    if not ends:
        return df.withColumn("fold", F.lit(None).cast("int"))
    spark = df.sparkSession
    # one row a class; sent to all tasks, as a shuffle would bring a class to one
    table = spark.createDataFrame([(c, [tuple(e) for e in mine]) for c, mine in ends], T.StructType([
        T.StructField("__class", df.schema[label].dataType),
        T.StructField("__ends", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("take", T.LongType())])))]))
    out = df.join(F.broadcast(table), col(label) == F.col("__class"), "left")
    k = col(key).cast("bigint")

    def fold(number: Column | None) -> Column:
        """How many folds end before the row; an end without a key lies before all rows."""
        over = lambda e: e["key"].isNull() | (e["key"] < k)
        if number is not None:
            past = over
            over = lambda e: past(e) | ((e["key"] == k) & (number > e["take"]))
        return F.when(F.col("__ends").isNotNull(), F.size(F.filter("__ends", over))).cast("int")

    if all(take is None for _, mine in ends for _, take in mine):
        return out.withColumn("fold", fold(None)).drop("__class", "__ends")
    shared = F.coalesce(F.exists("__ends", lambda e: (e["key"] == k) & e["take"].isNotNull()), F.lit(False))
    plain = out.filter(~shared).withColumn("fold", fold(None))
    number = F.row_number().over(Window.partitionBy(col(label), k).orderBy(k))
    some = out.filter(shared).withColumn("__no", number).withColumn("fold", fold(F.col("__no"))).drop("__no")
    return plain.unionByName(some).drop("__class", "__ends")


def _alloc(start: int, n: int, k: int) -> list[int]:
    """How many of positions start..start+n-1 are congruent to i mod k."""
    out = []
    for i in range(k):
        first = start + ((i - start) % k)
        out.append(0 if first >= start + n else (start + n - 1 - first) // k + 1)
    return out


@dataclass
class ModelScore:
    ordinal: int
    model: str
    metric: str
    value: float | None
    cv_mean: float | None = None
    cv_std: float | None = None
    extra: dict = field(default_factory=dict)
    importances: list = field(default_factory=list)
    error: str | None = None


def feature_importance(model, features: list[str], k: int = 5) -> list[tuple[str, float]]:
    """ML16: impurity importances, highest first (forests only)."""
    imp = getattr(model, "featureImportances", None)
    if imp is None:
        return []
    vals = imp.toArray().tolist()
    order = sorted(range(len(features)), key=lambda i: (-vals[i], i))
    return [(features[i], vals[i]) for i in order[:k]]


def interpretation_band(metric: Column, task: Column) -> Column:
    """ML18: accuracy or R² band."""
    return F.when(task == CLASSIFICATION, R.band_expr(metric, R.ACCURACY_BANDS)).otherwise(
        R.band_expr(metric, R.R2_BANDS))


@dataclass
class TrainResult:
    task: str
    target: str
    features: list[str]
    n_train: int
    n_test: int
    scores: list[ModelScore]
    best: ModelScore | None
    models: dict
    classes: list | None = None         # classification: the value of each label
    preparation: Preparation | None = None


def auto_train(df: DataFrame, target: str | None = None, split_key: Column | None = None,
               cv: bool = True, ids: tuple = (), forest_depth: int = FOREST_DEPTH,
               impute_on: str = "train", report_failures: bool = False) -> TrainResult:
    """ML19: the whole pipeline -- task, preparation, split, scaling, the two
    models of the task, metrics, CV (classification), importances, best.
    ``ids`` are key columns used by ``split_key`` but not as features. A
    classification target of any type and number of classes is indexed;
    ``forest_depth`` bounds the trees (10 unless given, Spark allows 30). The rows
    are split before anything is fitted; ``impute_on="all"`` takes the fills from
    all labelled rows. ``split_key`` reads the raw columns. A fit that fails raises
    (a lost executor or a full disk is no result); with ``report_failures`` the model
    is left out and its ``error`` says why, as the reference reports it."""
    target = target or df.columns[-1]
    task = task_of(df, target)
    base = drop_unlabelled(df, target)
    key = split_key if split_key is not None else row_key(base)
    # raw rows that are alike in the key are told apart by their hash, so folds do not
    # depend on where rows lie
    base = base.withColumn("__split", split_expr(key)).withColumn("__kid", F.xxhash64(key, *[col(c) for c in df.columns]))
    prep, n_rows = fit_preparation(base.drop("__kid"), target, task, F.col("__split") == "train",
                                   (*ids, "__split"), impute_on)
    feats = prep.features
    if not feats:
        raise ValueError("No usable feature columns found.")
    classes = None
    if task == CLASSIFICATION:
        classes = prep.classes = class_values(base, target)
    parts = fit_partitions(df.sparkSession, n_rows)
    base = base.withColumn("label", prep.label(base)).withColumn("__train", F.col("__split") == "train")
    folds = task == CLASSIFICATION and cv
    if folds:
        base = with_folds(base, "label", "__kid", fold_ends(base.filter("__train"), "label", "__kid", CV_FOLDS))
    data = prep.scaled(base, ["label", "__train", "__kid"] + ["fold"] * folds)
    # one cached table for all fits: a few numbers a row; vectors are made as they are read
    cached = dealt(data, parts).persist()
    data = prep.assemble(cached)
    if classes is not None:             # the classifiers take the number of classes from the label
        nominal = {"ml_attr": {"type": "nominal", "num_vals": max(2, len(classes))}}
        data = data.withColumn("label", F.col("label").alias("label", metadata=nominal))
    tr, te = data.filter("__train"), data.filter("NOT __train")
    n_train, n_test = tr.count(), te.count()
    names = MODELS[task]
    # every fit is independent: the final fits and the CV fold fits run as
    # concurrent Spark jobs from a small driver thread pool
    jobs = {}
    for f in [None, *(range(CV_FOLDS) if folds else ())]:       # in this order, the models in turn: their peaks differ
        for name in names:
            jobs[(name, f)] = (tr, te) if f is None else (tr.filter(F.col("fold") != f), tr.filter(F.col("fold") == f))

    def run(job):
        (name, _), (fit_on, score_on) = job
        model = make_estimator(name, n_train, forest_depth).fit(fit_on)
        pred = model.transform(score_on)
        if task == CLASSIFICATION:
            return model, {"value": accuracy(pred).first()["accuracy"]}
        m = regression_metrics(pred).first()
        return model, {"value": m["r2"], "rmse": m["rmse"], "mae": m["mae"]}

    outcomes = {}
    with ThreadPoolExecutor(max_workers=min(FIT_THREADS, len(jobs))) as pool:
        futures = {pool.submit(run, job): job[0] for job in jobs.items()}
        for fut, key in futures.items():
            try:
                outcomes[key] = fut.result()
            except Exception as e:  # noqa: BLE001 - raised below, when no fit is running any more
                outcomes[key] = e
    cached.unpersist()
    if not report_failures:
        for (name, fold), got in outcomes.items():
            if isinstance(got, Exception):
                raise RuntimeError(f"{name}{'' if fold is None else f', fold {fold},'} failed: {got}") from got
    scores, models, best = [], {}, None
    metric = "accuracy" if task == CLASSIFICATION else "r2"
    for i, name in enumerate(names, start=1):
        main = outcomes[(name, None)]
        if isinstance(main, Exception):
            s = ModelScore(i, name, metric, None, error=str(main))
        else:
            model, m = main
            s = ModelScore(i, name, metric, m["value"],
                           extra={k: v for k, v in m.items() if k != "value"})
            s.importances = feature_importance(model, feats)
            models[name] = model
            tried = [outcomes.get((name, f)) for f in range(CV_FOLDS)] if folds else []
            failed = [x for x in tried if isinstance(x, Exception)]
            if failed:
                s.error = f"cross-validation failed: {failed[0]}"
            if tried and not any(isinstance(x, Exception) or x is None for x in tried):
                accs = [x[1]["value"] for x in tried]
                s.cv_mean = sum(accs) / len(accs)
                s.cv_std = math.sqrt(sum((a - s.cv_mean) ** 2 for a in accs) / len(accs))
        scores.append(s)
        if s.value is not None and (best is None or s.value > best.value):
            best = s
    return TrainResult(task, target, feats, n_train, n_test, scores, best, models, classes, prep)


def leaderboard(result: TrainResult) -> DataFrame:
    """ML17: (ordinal, model, metric, value, cv_mean, cv_std, rmse, mae,
    best, band, error) -- best = highest value, first on ties."""
    spark = _active_spark()
    rows = [(s.ordinal, s.model, s.metric, s.value, s.cv_mean, s.cv_std,
             s.extra.get("rmse"), s.extra.get("mae"),
             result.best is not None and s.ordinal == result.best.ordinal, s.error)
            for s in result.scores]
    df = spark.createDataFrame(rows, "ordinal bigint, model string, metric string, value double, "
                                     "cv_mean double, cv_std double, rmse double, mae double, "
                                     "best boolean, error string")
    return df.withColumn("band", F.when(F.col("value").isNotNull(),
                                        interpretation_band(F.col("value"), F.lit(result.task))))


def best_model(board: DataFrame) -> DataFrame:
    """ML17: the top row by value, first ordinal on ties."""
    return board.orderBy(F.col("value").desc_nulls_last(), "ordinal").limit(1)


def model_result(result: TrainResult) -> DataFrame:
    """ML20: one-row record kept for later advice."""
    spark = _active_spark()
    feats = [f for f, _ in result.best.importances] if result.best else []
    if result.best and not feats:
        feats = next(([f for f, _ in s.importances] for s in result.scores if s.importances), [])
    row = [(result.task, result.best.model if result.best else None,
            result.best.value if result.best else None, feats, result.target,
            result.n_train, result.n_test)]
    return spark.createDataFrame(row, T.StructType([
        T.StructField("task", T.StringType()), T.StructField("best_model", T.StringType()),
        T.StructField("best_metric", T.DoubleType()),
        T.StructField("top_features", T.ArrayType(T.StringType())),
        T.StructField("target", T.StringType()), T.StructField("n_train", T.LongType()),
        T.StructField("n_test", T.LongType())]))


def importance_frame(result: TrainResult) -> DataFrame:
    """ML16 as a frame: (model, rank, feature, importance)."""
    spark = _active_spark()
    rows = [(s.model, r + 1, f, v) for s in result.scores for r, (f, v) in enumerate(s.importances)]
    return spark.createDataFrame(rows, "model string, rank bigint, feature string, importance double")


def predict(result: TrainResult, df: DataFrame, model_name: str | None = None) -> DataFrame:
    """ML21: score raw rows (same columns as the training table; the target
    may be missing) with a trained model, the best one unless named. All
    columns are kept; ``prediction`` and, for classes, ``predicted_class`` are
    added, in place of columns so named."""
    name = model_name or (result.best.model if result.best else None)
    return _score(result.preparation, result.models[name], df)


SCORES = ("prediction", "predicted_class")


def _score(prep: Preparation, model, df: DataFrame) -> DataFrame:
    packed = df.withColumn("__row", F.struct(*[col(c) for c in df.columns]))
    out = model.transform(prep.feature_vector(packed, ["__row"]))
    scores = [F.col("prediction")]
    if prep.classes:                    # the class itself, beside the label the model predicts
        values = F.array(*[F.lit(v) for v in prep.classes])
        scores.append(F.element_at(values, F.col("prediction").cast("int") + 1).alias("predicted_class"))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in df.columns if c not in SCORES], *scores)


@dataclass
class SavedModel:
    """A model and its preparation, read back from a folder."""
    preparation: Preparation
    name: str
    model: object

    def predict(self, df: DataFrame) -> DataFrame:
        return _score(self.preparation, self.model, df)


MODEL_CLASSES = {"Logistic Regression": LogisticRegressionModel, "Random Forest": RandomForestClassificationModel,
                 "Linear Regression": LinearRegressionModel, "Random Forest Regressor": RandomForestRegressionModel}


def save_pipeline(result: TrainResult, path: str, spark, model_name: str | None = None) -> str:
    """ML21: a trained model (default: the best one) with its preparation, as
    Parquet and Spark ML files under ``path``, to be scored by ``load_pipeline``."""
    name = model_name or (result.best.model if result.best else None)
    result.models[name].write().overwrite().save(os.path.join(path, "model"))
    result.preparation.save(os.path.join(path, "preparation"), spark)
    spark.createDataFrame([(name,)], "name string").write.mode("overwrite").parquet(os.path.join(path, "name"))
    return path


def load_pipeline(spark, path: str) -> SavedModel:
    name = spark.read.parquet(os.path.join(path, "name")).first()["name"]
    return SavedModel(Preparation.load(os.path.join(path, "preparation"), spark), name,
                      MODEL_CLASSES[name].load(os.path.join(path, "model")))


def save_model(result: TrainResult, path: str, model_name: str | None = None) -> str:
    """ML21 option: write a trained model (default: the best one) with Spark
    ML's writer, e.g. under the shared checkpoint folder."""
    name = model_name or (result.best.model if result.best else None)
    result.models[name].write().overwrite().save(path)
    return path


def _active_spark():
    """The session the trained models belong to (results hold no session)."""
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()
