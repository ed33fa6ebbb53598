"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. Every whole text becomes a vector of statistics (lengths, shares of symbols,
   repeated lines and words, capitals, marks, digits).
2. FEATURES random Fourier features of the standardized vector approximate a
   Gaussian kernel. Each partition of labelled rows sums its part of the normal
   equations; the sums meet in one aggregate, and the driver solves a system of
   FEATURES + 1 unknowns, whatever the number of rows.
3. The rows are in FOLDS folds, whose normal equations are summed apart. Each row's
   raw score by the weights of the other folds is counted on a fixed grid;
   pool-adjacent-violators turns the counts into a rising curve from raw score to
   the share of label 1. So every score is calibrated, however few rows there are.

Labels, language, source and doc_id are never inputs of a score. All labelled
rows take part; there is no sample.

Defined cases: a null or empty text has a vector and a score like any other;
rows with a null doc_id are never labelled; a label that is null is left out,
any other than 0 counts as 1; several labels of one document are as many
training rows; without training rows every score is 0.5, with one class alone
every score is that class; an empty table gives an empty result. Input columns
are kept; a clash with a result name is solved by renaming the input's column
(an underscore in front).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.quality_rules import vector_of
from tabsmith.llm.store import documents, free_name, save, ship, table
from tabsmith.llm.text_stats import COUNTS, column_counts
from tabsmith.llm.textbatch import tidy

FEATURES = 256
RIDGE = 1e-3
FOLDS = 3
SEED = 20240
#: Raw scores are counted in cells of this width, from -GRID_EDGE to 1 + GRID_EDGE.
CELL, GRID_EDGE = 1 / 512, 1.0


def vectors(col: pa.Array) -> np.ndarray:
    """The statistics of each text of a column."""
    counts = column_counts(col)
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    chars, words = c["n_chars"] + 1, c["n_words"] + 1
    return np.column_stack([vector_of(counts), np.sqrt(c["n_bangs"] / chars), np.sqrt(c["n_digits"] / chars),
                            np.sqrt(c["n_long_words"] / words), np.log(chars / (c["n_lines"] + 1))])


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


@dataclass
class Model:
    """What a score needs; all of it has a fixed size."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None       # of the features, the constant's last; None: a constant score
    knots: np.ndarray | None = None         # of the calibration curve: raw scores, and the shares there
    values: np.ndarray | None = None
    constant: float = 0.5

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        raw = np.clip(self.features(x) @ self.weights, -GRID_EDGE, 1 + GRID_EDGE)
        return np.interp(raw, self.knots, self.values)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardized rows, and a constant."""
    rng = np.random.default_rng(SEED)
    k = x.shape[1]
    directions = rng.standard_normal((k, FEATURES)) / np.sqrt(k)
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip(x, -12, 12)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ directions + phases), np.ones(len(x))])


def isotonic(raw: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve through pooled blocks of (raw score, rows, rows with label 1)."""
    blocks: list[list[float]] = []          # raw sum, rows, ones
    for r, a, b in zip(raw.tolist(), n.tolist(), ones.tolist()):
        blocks.append([r * a, a, b])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def _stack(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def fit(rows: DataFrame, id_col: str = "doc_id") -> Model:
    """A model of (id, v: array<double>, y: 0 or 1) rows."""
    ship(rows.sparkSession)
    size = rows.select(F.size("v")).first()
    if size is None:
        return Model(np.zeros(1), np.ones(1))
    k = size[0]
    at = [F.get("v", F.lit(i)) for i in range(k)]
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *(F.avg(a).alias(f"m{i}") for i, a in enumerate(at)),
                 *(F.stddev_pop(a).alias(f"s{i}") for i, a in enumerate(at))).first()
    model = Model(np.array([s[f"m{i}"] for i in range(k)]), np.maximum([s[f"s{i}"] for i in range(k)], 1e-3))
    if s.ones in (0, s.n):
        model.constant = float(s.ones > 0)
        return model
    fold = F.pmod(F.xxhash64(F.col(id_col)), F.lit(FOLDS)).cast("int")
    rows = rows.select(fold.alias("fold"), "v", F.col("y").cast("double").alias("y"))
    m = FEATURES + 1

    def normal(batches):
        a, b = np.zeros((FOLDS, m, m)), np.zeros((FOLDS, m))
        for batch in batches:
            folds = batch.column(0).to_numpy()
            z, y = (model.features(_stack(batch.column(1))), batch.column(2).to_numpy()) if batch.num_rows else (None, None)
            for f in np.unique(folds):
                of = z[folds == f]
                a[f] += of.T @ of
                b[f] += of.T @ y[folds == f]
        i, j = np.triu_indices(m)
        for f in range(FOLDS):
            yield pa.RecordBatch.from_pydict({
                "fold": np.full(len(i) + m, f, np.int32), "i": np.concatenate([i, np.arange(m)]).astype(np.int32),
                "j": np.concatenate([j, np.full(m, -1)]).astype(np.int32), "s": np.concatenate([a[f][i, j], b[f]])})

    sums = rows.mapInArrow(normal, "fold int, i int, j int, s double").groupBy("fold", "i", "j").agg(F.sum("s").alias("s"))
    a, b = np.zeros((FOLDS, m, m)), np.zeros((FOLDS, m))
    for f, i, j, v in sums.collect():       # FOLDS * m * (m + 3) / 2 rows
        if j < 0:
            b[f, i] = v
        else:
            a[f, i, j] = a[f, j, i] = v

    def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = max(1.0, a[-1, -1])
        penalty = np.full(m, RIDGE * n)
        penalty[-1] = 1e-9 * n
        return np.linalg.solve(a + np.diag(penalty), b)

    others = np.column_stack([solve(a.sum(axis=0) - a[f], b.sum(axis=0) - b[f]) for f in range(FOLDS)])

    def raw_cells(batches):
        for batch in batches:
            if batch.num_rows:
                raw = model.features(_stack(batch.column(1))) @ others
                raw = np.clip(raw[np.arange(len(raw)), batch.column(0).to_numpy()], -GRID_EDGE, 1 + GRID_EDGE)
                yield pa.RecordBatch.from_pydict({"cell": np.floor(raw / CELL).astype(np.int32), "y": batch.column(2)})

    cells = (rows.mapInArrow(raw_cells, "cell int, y double")
             .groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).orderBy("cell").collect())
    model.weights = solve(a.sum(axis=0), b.sum(axis=0))
    model.knots, model.values = isotonic(np.array([(c.cell + 0.5) * CELL for c in cells]),
                                         np.array([c.n for c in cells], float), np.array([c.ones for c in cells], float))
    return model


def with_vectors(docs: DataFrame, text_col: str, name: str = "v") -> DataFrame:
    """``docs`` with the vector of its texts in the place of the texts."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if i != at]

    def run(batches):
        for b in batches:
            x = vectors(b.column(at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), lists], names=[*(b.schema.names[i] for i in kept), name])

    fields = [docs.schema.fields[i] for i in kept]
    return docs.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def with_score(rows: DataFrame, model: Model, vector: str | None = "v", text_col: str | None = None) -> DataFrame:
    """``rows`` plus score (double) and predicted (int), from their vectors or from their texts."""
    ship(rows.sparkSession)
    at = rows.columns.index(text_col or vector)

    def run(batches):
        for b in batches:
            x = vectors(b.column(at)) if text_col else _stack(b.column(at))
            score = model.score(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=[*b.schema.names, "score", "predicted"])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()),
                                              T.StructField("predicted", T.IntegerType())]))


def _training(vectored: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    mod = crc_mod("label_id", 3)
    y = labels.select(F.col(id_col).alias("label_id"), (F.col(label_col) != 0).cast("int").alias("y"))
    y = y.where(F.col("y").isNotNull() & (mod != 1))
    return vectored.select(F.col(id_col).alias("id"), "v").join(y, F.col("id") == F.col("label_id")).select("id", "v", "y")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """``docs`` plus score and predicted, learnt from the labels outside the held-out third."""
    for name in ("score", "predicted"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, free_name(docs.columns, name))
    vectored = save(with_vectors(docs.select(id_col, text_col), text_col), "quality-vectors")
    model = fit(save(_training(vectored, labels, id_col, label_col), "quality-training"), "id")
    return with_score(docs, model, text_col=text_col)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectored = save(with_vectors(documents(spark, sf_dir).select("doc_id", "text"), "text"), "quality-vectors")
    model = fit(save(_training(vectored, table(spark, sf_dir, "labels"), "doc_id", "quality"), "quality-training"), "id")
    out = with_score(vectored, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
