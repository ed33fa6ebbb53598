"""Quality rules and quality classifier."""
import random
import re
import zlib

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from tabsmith.llm import quality_classifier as qc
from tabsmith.llm import quality_rules as qr
from tabsmith.llm.text_stats import COUNTS, column_counts

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(t),
            len(lines), len(set(w))]


def test_counts_equal_plain_python():
    rng = random.Random(3)
    alphabet = ["a", "b", " ", chr(0xE9), "\n", "\t", " ", "#", "|", chr(0x6F22), "\x1c"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += [None, "", "a", "\n", "a b c a b c", "a b c " * 20_000, "\n\nx\n\nx\n"]
    got = column_counts(pa.array(texts))
    assert got[:, :8].tolist() == [brute(t) for t in texts]
    assert column_counts(pa.array([], pa.string())).shape == (0, len(COUNTS))


def test_rules_reject_junk_and_keep_clean_documents(spark):
    rows = qr.op1_quality_rules(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        b = brute(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == b[:5]
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)
    judged = [r for r in rows if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in judged if labels[r.doc_id]]
    bad = [r.kept for r in judged if not labels[r.doc_id]]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_estimate_withstands_outliers(spark):
    """With a quarter of outliers in one group, the estimate stays at the clean rows'."""
    rng = np.random.default_rng(7)
    clean = rng.normal(1.0, 0.5, (3000, qr.P))
    far = rng.normal(9.0, 0.1, (900, qr.P))
    rows = [("en", "hot", True, *map(float, x)) for x in np.vstack([clean, far])]
    rows += [("en", f"s{i % 7}", True, *map(float, x)) for i, x in enumerate(rng.normal(0, 0.5, (210, qr.P)))]
    rows += [("xx", None, True, *([0.0] * qr.P))] * 3
    cols = "lang string, source string, fit boolean, " + ", ".join(f"{x} double" for x in qr.XS)
    stats = spark.createDataFrame(rows, cols).repartition(6)
    est = {(r.lang, r.source): r for r in qr.estimates(stats, "lang", "source").collect()}
    assert set(est) == {("en", "hot"), ("xx", "\x00")} | {("en", f"s{i}") for i in range(7)}
    mean = np.array(est[("en", "hot")].mean)
    assert np.abs(mean - 1.0).max() < 0.1
    cov = np.linalg.inv(np.array(est[("en", "hot")].inverse).reshape(qr.P, qr.P))
    assert np.allclose(np.diag(cov), 0.25 + np.square(qr.FLOORS), rtol=0.2)
    d = qr.judge(stats.withColumn("base_failed", F.lit(False)), spark.createDataFrame(list(est.values())), "lang", "source", 1e-12)
    got = {r.source: (r["k"], r["n"]) for r in d.groupBy("source").agg(F.sum(F.col("kept").cast("int")).alias("k"),
                                                                      F.count("*").alias("n")).collect()}
    assert got["hot"] == (3000, 3900) and got[None] == (3, 3)


def test_every_document_is_judged_on_a_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = qr.op1_quality_rules(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [r for r in rows if not r.base_failed]
    assert judged and all(r.distance is not None and r.kept == (r.distance <= qr.chi2_cut(qr.TAIL)) for r in judged)
    good = [r.kept for r in judged if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in judged if labels.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) < len(bad)


def test_a_rare_language_is_judged_on_a_large_table(spark):
    rng = np.random.default_rng(3)
    rows = [("en", "web", True, *map(float, x)) for x in rng.normal(1.0, 0.3, (3000, qr.P))]
    rows += [("xx", "web", True, *([1.1] * qr.P)), ("xx", "web", True, *([9.0] * qr.P)), ("yy", None, False, *([9.0] * qr.P))]
    cols = "lang string, source string, fit boolean, " + ", ".join(f"{x} double" for x in qr.XS)
    stats = spark.createDataFrame(rows, cols).repartition(4).withColumn("base_failed", ~F.col("fit"))
    out = qr.judge(stats, qr.estimates(stats, "lang", "source"), "lang", "source", qr.TAIL).collect()
    assert len(out) == len(rows) and all((r.distance is None) == (r.lang == "yy") for r in out)
    assert sorted((r.x0, r.kept) for r in out if r.lang == "xx") == [(1.1, True), (9.0, False)]


def plain_mcd(x):
    """Mean and covariance by concentration of whole vectors from the two starts, then one reweighted step."""
    floors = np.square(qr.FLOORS)

    def distance(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + np.diag(floors)), x - mean)

    def nearest(d, share):
        h = int(np.ceil(share * len(x)))
        part = x[np.argsort(d, kind="stable")[:h]]
        return part.mean(axis=0), np.cov(part.T, bias=True) * qr._consistency(share)

    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    spread = np.maximum((q[2] - q[0]) / 1.349, qr.FLOORS)
    t = np.tanh((x - q[1]) / spread)
    c = np.cov(t.T, bias=True) + 1e-6 * np.eye(qr.P)
    best = None
    for corr in (np.eye(qr.P), c / np.sqrt(np.outer(np.diag(c), np.diag(c)))):
        mean, cov = q[1], corr * np.outer(spread, spread)
        for _ in range(qr.STEPS):
            mean, cov = nearest(distance(mean, cov), qr.H)
        det = np.linalg.slogdet(cov + np.diag(floors))[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    part = x[distance(best[1], best[2]) <= qr.chi2_cut(qr.TRIM)]
    return part.mean(axis=0), np.cov(part.T, bias=True) * qr._consistency(1 - qr.TRIM) + np.diag(floors)


def test_verdict_equals_a_plain_mcd(spark):
    """Every document's verdict, by estimates of whole groups in numpy (the distributed steps go by bins)."""
    stats = qr.with_statistics(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source", "text"), "text")
    rows = stats.withColumn("fit", ~qr.base_failed(50)).collect()
    fit = [r for r in rows if r.fit]
    x = {r.doc_id: np.array([r[c] for c in qr.XS]) for r in rows}

    def mixed(own, n, parent):
        w, off = n * n / (n * n + qr.SHRINK ** 2), own[0] - parent[0]
        return w * own[0] + (1 - w) * parent[0], w * own[1] + (1 - w) * parent[1] + w * (1 - w) * np.outer(off, off)

    every = plain_mcd(np.array([x[r.doc_id] for r in fit]))
    got = {r.doc_id: r for r in qr.op1_quality_rules(spark, SF).collect()}
    near = 0
    for lang, source in {(r.lang, r.source) for r in fit}:
        of_lang = [r for r in fit if r.lang == lang]
        of = [r for r in of_lang if r.source == source]
        now = mixed(plain_mcd(np.array([x[r.doc_id] for r in of_lang])), len(of_lang), every)
        now = mixed(plain_mcd(np.array([x[r.doc_id] for r in of])), len(of), now)
        inverse = np.linalg.inv(now[1])
        for r in of:
            d = float((x[r.doc_id] - now[0]) @ inverse @ (x[r.doc_id] - now[0]))
            cut = qr.chi2_cut(qr.TAIL)
            if abs(d - cut) < 0.1 * cut:            # within what the bins can move
                near += 1
            else:
                assert got[r.doc_id].kept == (d <= cut), (r.doc_id, d, got[r.doc_id].distance)
    assert near < 0.01 * len(fit)


def test_structured_words_do_not_meet(spark):
    """Words and lines that powers of one base cannot tell apart (Thue-Morse strings)."""
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    counts = dict(zip(COUNTS, column_counts(pa.array([f"{x} {y}\n{y} {x}\n{x}\n{y}"])).tolist()[0]))
    assert counts["n_distinct"] == 2 and counts["n_dup_lines"] == 0 and counts["n_words"] == 6


def test_chi2_cut():
    assert abs(qr.chi2_cut(0.05, 8) - 15.507) < 1e-3 and abs(qr.chi2_cut(0.01, 10) - 23.209) < 1e-3


def test_rules_edges(spark):
    df = spark.createDataFrame([(1, None, None, None, 5), (2, "", "en", None, 5), (3, "word " * 60, None, "s", 5)] * 2,
                               "doc_id long, text string, lang string, source string, kept int")
    out = qr.quality_rules(df)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "_kept"]
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in out.collect()) == sorted(
        [(1, True, False), (2, True, False), (3, True, False)] * 2)
    assert qr.quality_rules(df.limit(0)).collect() == []


# --------------------------------------------------------------------- classifier

def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in qc.op6_quality_classifier(spark, SF).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
               for d, r in rows.items())
    held = [(rows[d].predicted, q) for d, q in labels if rows[d].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.97


def test_isotonic_rises_and_pools():
    x, y = qc.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([2.0, 2, 2, 2]), np.array([1.0, 0, 2, 1]))
    assert y.tolist() == [0.25, 0.75] and np.allclose(x, [0.15, 0.35])


def plain_scores(x, y, fold):
    """Cross-fitted ridge scores of random Fourier features, calibrated, without sums by partition."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = qc.fourier((x - mean) / scale)

    def solve(rows):
        pen = np.full(z.shape[1], qc.RIDGE * max(1, len(rows)))
        pen[-1] = 1e-9 * max(1, len(rows))
        return np.linalg.solve(z[rows].T @ z[rows] + np.diag(pen), z[rows].T @ y[rows])

    raw = np.zeros(len(x))
    for f in range(qc.FOLDS):
        raw[fold == f] = z[fold == f] @ solve(np.flatnonzero(fold != f))
    cell = np.floor(np.clip(raw, -qc.GRID_EDGE, 1 + qc.GRID_EDGE) / qc.CELL).astype(int)
    cells = np.unique(cell)
    knots, values = qc.isotonic((cells + 0.5) * qc.CELL, np.array([float((cell == c).sum()) for c in cells]),
                                np.array([float(y[cell == c].sum()) for c in cells]))
    return np.interp(np.clip(z @ solve(np.arange(len(x))), -qc.GRID_EDGE, 1 + qc.GRID_EDGE), knots, values)


@pytest.mark.parametrize("n", [400, 12])
def test_scores_equal_the_plain_ones(spark, n):
    """For many labels, and for so few that folds hold four."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "doc_id long, v array<double>, y int").repartition(5)
    fold = {r.doc_id: r.f for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(qc.FOLDS)).alias("f")).collect()}
    model = qc.fit(df)
    want = plain_scores(x, y, np.array([fold[i] for i in range(n)]))
    assert np.allclose(model.score(x), want, atol=1e-6)
    if n == 400:
        assert ((want >= 0.5) == y).mean() > 0.9            # no linear score could


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (2, "a b", 9.0), (None, "c", 9.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = qc.classify(docs, none)
    assert out.columns == ["doc_id", "text", "_score", "score", "predicted"]
    assert [r.score for r in out.collect()] == [0.5] * 4
    assert qc.classify(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(1, 0), (2, 0), (2, None), (4, 0), (7, 1)], "doc_id long, quality int")
    ids = [r.doc_id for r in one.where("quality = 0 AND doc_id < 3").where(qc.crc_mod("doc_id", 3) != 1).collect()]
    if ids:
        assert {r.score for r in qc.classify(docs, one.where("quality = 0 OR quality IS NULL")).collect()} == {0.0}
