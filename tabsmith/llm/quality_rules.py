"""Quality rules: robust multivariate outliers of text statistics.

Every text becomes a vector of transformed statistics (``vector_of``). For each
language and source the minimum covariance determinant is estimated: the mean
and covariance of the share H of the vectors whose covariance has the smallest
determinant. Texts with a large Mahalanobis distance from it are rejected.

The estimate is distributed. A concentration step is one aggregate over all
vectors: each group's vectors are put into narrow bins of distance, each bin has
its count and moments, and a group's next estimate is the sum over its nearest
bins (of the bin at the border, the share that completes H). A group is never
gathered, so one source may hold any part of the rows. Two deterministic starts
(quartiles alone; quartiles with the correlations of squashed values) take
STEPS steps; the one with the smaller determinant goes on to one reweighted step.
A floor on each statistic's spread keeps the covariance regular where most texts
have the same value (no symbols, no repeated lines).

Only texts that pass the base rules shape the estimates. An estimate of n texts is
mixed into its parent's by the weight n^2 / (n^2 + SHRINK^2): a language and source's
into its language's, a language's into that of all texts. The same holds for groups of
every size, so none is judged by another rule, and a handful of texts, which may be
outliers themselves, hardly counts. The mixture has the mean and covariance of both.

Defined cases: a null or empty text has no words and fails the base rules; a
null language or source is a value of its own; repeated rows are judged one by
one; an empty table gives an empty result. Input columns are kept by
``quality_rules``; a clash with a result name is solved by renaming the input's
column (an underscore in front).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.store import documents, free_name, save, ship
from tabsmith.llm.text_stats import COUNTS, column_counts
from tabsmith.llm.textbatch import tidy

H = 0.75
STEPS = 4
#: The share of a Gaussian's distances beyond the cut of the reweighted step, and beyond the verdict's.
TRIM, TAIL = 0.025, 1e-12
#: The least standard deviation of each statistic, in the order of ``vector_of``.
FLOORS = (0.25, 0.03, 0.03, 0.15, 0.15, 0.05, 0.03, 0.03)
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
BINS = 24                       # bins of distance for each doubling
#: Texts of a group whose own estimate counts as much as its parent's.
SHRINK = 100
XS = [f"x{i}" for i in range(P)]


def vector_of(counts: np.ndarray) -> np.ndarray:
    """The transformed statistics of rows of COUNTS: lengths on a log scale, shares by square root."""
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    words, chars, lines = c["n_words"] + 1, c["n_chars"] + 1, c["n_lines"] + 1
    return np.column_stack([
        np.log(words), np.log((c["word_chars"] + 1) / words), np.sqrt(c["n_symbols"] / chars),
        np.sqrt(c["n_dup_lines"] / lines), np.sqrt(c["n_repeat_words"] / words), np.log((c["n_distinct"] + 1) / words),
        np.sqrt(c["n_upper"] / chars), np.sqrt(c["n_marks"] / chars)])


def _chi2_above(x: float, k: int) -> float:
    """The share of a chi-squared variable of an even number k of degrees above x."""
    term = total = 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return math.exp(-x / 2) * total


def chi2_cut(share_above: float, k: int = P) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_above(mid, k) > share_above else (lo, mid)
    return hi


def _consistency(share: float) -> float:
    """What the covariance of the nearest share of a Gaussian is multiplied by to be the whole one's."""
    return share / (1 - _chi2_above(chi2_cut(1 - share), P + 2)) if share < 1 else 1.0


# -------------------------------------------------------------------- statistics

def _names(docs: DataFrame, names) -> DataFrame:
    for name in names:
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, free_name(docs.columns, name))
    return docs


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` plus COUNTS (long) and the vector x0, x1, ... (double)."""
    ship(docs.sparkSession)
    docs = _names(docs, [*COUNTS, *XS])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            counts = column_counts(b.column(at))
            vectors = vector_of(counts)
            made = [pa.array(np.ascontiguousarray(a[:, k])) for a in (counts, vectors) for k in range(a.shape[1])]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *COUNTS, *XS])

    extra = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(x, T.DoubleType()) for x in XS]
    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *extra]))


def base_failed(min_words: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# --------------------------------------------------------------------- estimates

PARAMS = f"g long, start int, mean array<double>, inverse array<double>, logdet double, n long"


def _params(g: int, start: int, mean: np.ndarray, cov: np.ndarray, n: int):
    import pandas as pd
    cov = cov + np.diag(np.square(FLOORS))
    sign, logdet = np.linalg.slogdet(cov)
    if sign <= 0 or not np.isfinite(logdet):
        cov = np.diag(np.maximum(np.diag(cov), np.square(FLOORS)))
        logdet = float(np.log(np.diag(cov)).sum())
    return pd.DataFrame({"g": [g], "start": [start], "mean": [mean.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()],
                         "logdet": [float(logdet)], "n": [n]})


def _distance(xs: list[Column], mean: str = "mean", inverse: str = "inverse") -> Column:
    diff = [x - F.get(F.col(mean), F.lit(i)) for i, x in enumerate(xs)]
    total = None
    for i, j in PAIRS:
        term = F.get(F.col(inverse), F.lit(i * P + j)) * diff[i] * diff[j] * (1 if i == j else 2)
        total = term if total is None else total + term
    return F.greatest(total, F.lit(0.0))


def _moments(values: list[Column]) -> list[Column]:
    return ([F.count(F.lit(1)).alias("n")] + [F.sum(v).alias(f"s{i}") for i, v in enumerate(values)]
            + [F.sum(values[i] * values[j]).alias(f"q{i}_{j}") for i, j in PAIRS])


def _sums(pdf, weights) -> tuple[float, np.ndarray, np.ndarray]:
    n = float((pdf.n * weights).sum())
    s = np.array([(pdf[f"s{i}"] * weights).sum() for i in range(P)])
    q = np.zeros((P, P))
    for i, j in PAIRS:
        q[i, j] = q[j, i] = (pdf[f"q{i}_{j}"] * weights).sum()
    return n, s, q


def _next(pdf, share: float | None):
    """The estimate from a group's bins of distances: the nearest ``share``, or all of them."""
    pdf = pdf.sort_values("bin")
    total = int(pdf.n.sum())
    weights = np.ones(len(pdf))
    if share is not None:
        want = math.ceil(share * total)
        before = pdf.n.cumsum().to_numpy() - pdf.n.to_numpy()
        weights = np.clip((want - before) / pdf.n.to_numpy(), 0.0, 1.0)
    n, s, q = _sums(pdf, weights)
    shift = s / n                                   # moments are about the mean before
    cov = (q / n - np.outer(shift, shift)) * _consistency(share if share is not None else 1 - TRIM)
    mean = np.array(pdf["mean"].iloc[0]) + shift
    return _params(int(pdf.g.iloc[0]), int(pdf.start.iloc[0]), mean, cov, total)


def _step(vectors: DataFrame, params: DataFrame, share: float | None) -> DataFrame:
    rows = vectors.join(params, "g")
    rows = rows.withColumn("d2", _distance([F.col(x) for x in XS]))
    if share is None:
        rows = rows.where(F.col("d2") <= chi2_cut(TRIM)).withColumn("bin", F.lit(0))
    else:
        rows = rows.withColumn("bin", F.floor(F.log2(F.col("d2") + 1.0) * BINS).cast("int"))
    rows = rows.withColumns({f"y{i}": F.col(x) - F.get("mean", F.lit(i)) for i, x in enumerate(XS)})
    bins = (rows.groupBy("g", "start", "bin")
            .agg(F.first("mean").alias("mean"), *_moments([F.col(f"y{i}") for i in range(P)])))
    return save(bins.groupBy("g", "start").applyInPandas(lambda pdf: _next(pdf, share), PARAMS), "mcd")


def _starts(vectors: DataFrame) -> DataFrame:
    """Two first estimates of each group."""
    quartiles = vectors.groupBy("g").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"t{i}")
                                           for i, x in enumerate(XS)))
    spread = [F.greatest((F.get(f"t{i}", F.lit(2)) - F.get(f"t{i}", F.lit(0))) / 1.349, F.lit(FLOORS[i])) for i in range(P)]
    quartiles = save(quartiles.select("g", F.array(*(F.get(f"t{i}", F.lit(1)) for i in range(P))).alias("mean"),
                                      F.array(*spread).alias("spread")), "mcd-quartiles")
    rows = vectors.join(quartiles, "g")
    rows = rows.withColumns({f"y{i}": F.tanh((F.col(x) - F.get("mean", F.lit(i))) / F.get("spread", F.lit(i)))
                             for i, x in enumerate(XS)})
    squashed = rows.groupBy("g").agg(F.first("mean").alias("mean"), F.first("spread").alias("spread"),
                                     *_moments([F.col(f"y{i}") for i in range(P)]))

    def both(batches):
        import pandas as pd
        for pdf in batches:
            for k in range(len(pdf)):
                row = pdf.iloc[[k]]
                n, s, q = _sums(row, np.ones(1))
                cov = q / n - np.outer(s / n, s / n) + 1e-6 * np.eye(P)
                d = np.sqrt(np.diag(cov))
                mean, spread = np.array(row["mean"].iloc[0]), np.array(row["spread"].iloc[0])
                for start, corr in ((0, np.eye(P)), (1, cov / np.outer(d, d))):
                    yield _params(int(row.g.iloc[0]), start, mean, corr * np.outer(spread, spread), int(n))

    return save(squashed.mapInPandas(both, PARAMS), "mcd-start")


def _shrunk(batches):
    """(lang, source, mean, inverse) of a language and source's estimate, mixed with its language's and that of all."""
    import pandas as pd

    def moments(mean, inverse):
        return np.array(mean), np.linalg.inv(np.array(inverse).reshape(P, P)) if inverse is not None else None

    def mix_in(own, n, parent):
        if own[1] is None or not n:
            return parent
        w, off = n * n / (n * n + SHRINK * SHRINK), own[0] - parent[0]
        return w * own[0] + (1 - w) * parent[0], w * own[1] + (1 - w) * parent[1] + w * (1 - w) * np.outer(off, off)

    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            now = moments(r.mean0, r.inverse0)
            for mean, inverse, n in ((r.mean1, r.inverse1, r.n1), (r.mean2, r.inverse2, r.n2)):
                now = mix_in(moments(mean, inverse), n, now)
            out.append((r.lang, r.source, now[0].tolist(), np.linalg.inv(now[1]).ravel().tolist()))
        yield pd.DataFrame(out, columns=["lang", "source", "mean", "inverse"])


def estimates(stats: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, mean, inverse) of each language and source of ``stats`` with rows that shape estimates.

    ``stats`` needs lang, source, the vector and ``fit`` (whether a row shapes the estimate)."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (lang_col, source_col))
    fit = stats.where("fit").select(lang.alias("lang"), source.alias("source"), *XS)
    sizes = fit.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n2"))
    sizes = save(sizes.withColumn("n1", F.sum("n2").over(Window.partitionBy("lang"))), "mcd-groups")
    # every row shapes three estimates: of all rows, of its language, of its language and source
    of = [F.lit(0).cast("long"), F.xxhash64(F.lit("lang"), "lang"), F.xxhash64(F.lit("own"), "lang", "source")]
    vectors = save(fit.select(F.explode(F.array(*of)).alias("g"), *XS), "mcd-vectors")
    params = _starts(vectors)
    for _ in range(STEPS):
        params = _step(vectors, params, H)
    best = params.groupBy("g").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    params = save(params.join(best, ["g", "start"]), "mcd-best")
    params = _step(vectors, params, None)
    rows = sizes
    for k, key in enumerate(of):
        level = params.select(F.col("g").alias(f"g{k}"), F.col("mean").alias(f"mean{k}"), F.col("inverse").alias(f"inverse{k}"))
        rows = rows.withColumn(f"g{k}", key).join(level, f"g{k}", "left").drop(f"g{k}")
    shape = "lang string, source string, mean array<double>, inverse array<double>"
    return save(rows.where("mean0 IS NOT NULL").mapInPandas(_shrunk, shape), "mcd-estimates")


def judge(stats: DataFrame, params: DataFrame, lang_col: str, source_col: str, tail: float) -> DataFrame:
    """``stats`` plus ``distance`` (double, null in a language and source without a row that passes the base
    rules) and ``kept`` (boolean)."""
    p = params.select(F.col("lang").alias("_pl"), F.col("source").alias("_ps"), F.col("mean").alias("_pm"),
                      F.col("inverse").alias("_pi"))
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (lang_col, source_col))
    out = stats.join(p, (lang == F.col("_pl")) & (source == F.col("_ps")), "left")
    out = out.withColumn("distance", _distance([F.col(x) for x in XS], "_pm", "_pi"))
    out = out.withColumn("distance", F.when(F.col("_pm").isNotNull(), F.col("distance")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_cut(tail), F.lit(True))
    return out.withColumn("kept", kept).drop("_pl", "_ps", "_pm", "_pi")


def quality_rules(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  min_words: int = 50, tail: float = TAIL) -> DataFrame:
    """``docs`` plus COUNTS, base_failed, distance and kept."""
    docs = _names(docs, ("base_failed", "distance", "kept", "fit"))
    stats = with_statistics(docs, text_col).withColumn("base_failed", base_failed(min_words))
    narrow = save(stats.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                               (~F.col("base_failed")).alias("fit"), *XS), "quality-stats")
    return judge(stats, estimates(narrow, "lang", "source"), lang_col, source_col, tail).drop(*XS)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    # the verdict needs the statistics alone, so they are kept instead of being counted again
    stats = save(with_statistics(docs, "text").drop("text").withColumn("base_failed", base_failed(50))
                 .withColumn("fit", ~F.col("base_failed")), "quality-stats")
    out = judge(stats, estimates(stats, "lang", "source"), "lang", "source", TAIL)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "distance")
