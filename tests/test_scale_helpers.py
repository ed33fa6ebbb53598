"""The distributed helpers against brute force, including the code paths that
only large inputs reach (forced with small thresholds) and hot keys."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsmith.functions import positions as P
from tabsmith.functions import quantiles as Q
from tabsmith.functions.ranking import dense_codes


@pytest.fixture()
def small_thresholds(monkeypatch):
    monkeypatch.setattr(Q, "FINAL_MAX", 50)
    monkeypatch.setattr(Q, "BINS", 8)
    monkeypatch.setattr(P, "RANGES", 2)
    monkeypatch.setattr(P, "PARTS", 2)


def _data(spark, n=4000, seed=0):
    rng = np.random.default_rng(seed)
    vals = np.concatenate([rng.normal(0, 1, n), np.full(n // 2, 0.25),  # a hot value
                           rng.exponential(100, n // 4)])
    rng.shuffle(vals)
    groups = np.where(rng.random(len(vals)) < 0.6, "hot", rng.choice(["a", "b", "c"], len(vals)))
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(groups, vals)],
                               "g string, x double")
    return df, vals, groups


def _pandas_quantile(v, p):
    return float(np.quantile(v, p))


def test_quantiles_refine_path(spark, small_thresholds):
    df, vals, _ = _data(spark)
    st = Q.column_stats(df, ["x"])
    got = Q.quantiles(df, ["x"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], st)
    for p in [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]:
        assert got[("x", p)] == pytest.approx(_pandas_quantile(vals, p), rel=1e-12, abs=1e-12)


def test_grouped_quantiles_hot_group(spark, small_thresholds):
    df, vals, groups = _data(spark, 3000, 1)
    q, st = Q.grouped_quantiles(df, "g", ["x"], [0.5, 0.9])
    for g in ["hot", "a", "b", "c"]:
        v = vals[groups == g]
        assert st[(g, "x")][0] == len(v)
        for p in [0.5, 0.9]:
            assert q[(g, "x", p)] == pytest.approx(_pandas_quantile(v, p), rel=1e-12, abs=1e-12)


def test_positions_hot_group(spark, small_thresholds):
    rng = np.random.default_rng(2)
    keys = rng.permutation(5000)
    grp = np.where(rng.random(5000) < 0.7, 0, rng.integers(1, 20, 5000))
    df = spark.createDataFrame([(int(g), int(k)) for g, k in zip(grp, keys)], "g long, k long")
    ours = P.positions(df, ["g"], "k", out="pos", total="n")
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    joined = ours.join(ref, ["g", "k"])
    assert joined.filter("pos != rn").count() == 0
    assert joined.count() == 5000
    sizes = {r["g"]: r["n"] for r in ours.select("g", "n").distinct().collect()}
    assert sizes[0] == int((grp == 0).sum())


def test_dense_codes(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 5))) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    codes = {r["w"]: r["code"] for r in dense_codes(df, "w", partitions=5).collect()}
    expected = {w: i for i, w in enumerate(sorted(set(words)))}
    assert codes == expected


def test_grouped_quantiles_many_small_groups(spark, monkeypatch):
    monkeypatch.setattr(Q, "FINAL_MAX", 300)
    rng = np.random.default_rng(9)
    n = 20000
    groups = np.where(rng.random(n) < 0.3, 0, rng.integers(1, 400, n))   # one hot group
    vals = np.round(rng.normal(0, 10, n), 1)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)],
                               "g long, x double")
    rows = Q.grouped_quantiles_frame(df, "g", ["x"], [0.25, 0.5]).collect()
    assert len(rows) == len(set(groups.tolist()))
    for r in rows:
        v = vals[groups == int(r["g"])]
        assert r["n"] == len(v)
        assert r["q0"] == pytest.approx(float(np.quantile(v, 0.25)), abs=1e-9)
        assert r["q1"] == pytest.approx(float(np.quantile(v, 0.5)), abs=1e-9)


def test_hash_dedup_matches_drop_duplicates(spark):
    from tabsmith.functions.duplicates import drop_duplicate_rows, duplicate_stats
    rows = [(1, 0.0, "a"), (1, -0.0, "a"), (None, None, None), (None, None, None),
            (2, 1.5, None), (2, 1.5, "b"), (3, 2.0, "c")] * 3 + [(4, 4.0, "d")]
    df = spark.createDataFrame(rows, "i long, x double, s string")
    st = duplicate_stats(df)
    assert st.rows == len(rows)
    assert st.distinct == df.dropDuplicates().count() == 6
    def key(r):
        return tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r) for r in drop_duplicate_rows(df).collect()), key=key)
    exp = sorted((tuple(r) for r in df.dropDuplicates().collect()), key=key)
    assert len(got) == len(exp) == 6
    unique = spark.createDataFrame([(i, float(i)) for i in range(100)], "i long, x double")
    assert duplicate_stats(unique).candidates is None
    assert drop_duplicate_rows(unique).count() == 100


def test_hash_dedup_fallback_many_duplicates(spark, monkeypatch):
    from tabsmith.functions import duplicates as D
    monkeypatch.setattr(D, "BROADCAST_HASHES", 0)
    df = spark.createDataFrame([(i % 7, "x") for i in range(200)], "k long, s string")
    st = D.duplicate_stats(df)
    assert (st.rows, st.distinct) == (200, 7)
    assert D.drop_duplicate_rows(df).count() == 7


def test_label_encode_paths_agree(spark, monkeypatch):
    from tabsmith.operators import automl as ml
    rows = [(i, None if i % 9 == 0 else f"v{i % 37}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s string")
    small = {r["id"]: r["s"] for r in ml.label_encode(df, ["s"]).collect()}
    monkeypatch.setattr(ml, "SMALL_CODES", 1)
    dense = {r["id"]: r["s"] for r in ml.label_encode(df, ["s"]).collect()}
    assert small == dense
    values = sorted({("nan" if s is None else s) for _, s in rows})
    assert small[0] == values.index("nan")


def test_unbroadcast_paths(spark, monkeypatch):
    """With the broadcast bounds at zero every size-checked join takes its
    shuffle path and the results stay the same."""
    from tabsmith.operators import automl as ml
    from tabsmith.sources import dataset as ds
    nation = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    region = spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    ref = {r["n_nationkey"]: r["region_name"]
           for r in ds.decode_labels(nation, "n_regionkey", region, "r_regionkey", "r_name",
                                     "region_name").collect()}
    df = spark.createDataFrame([(i, f"k{i % 5}") for i in range(100)], "i long, s string")
    a = {r["i"]: r["s"] for r in ml.label_encode(df, ["s"]).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # a shuffle join instead
    try:
        got = {r["n_nationkey"]: r["region_name"]
               for r in ds.decode_labels(nation, "n_regionkey", region, "r_regionkey", "r_name",
                                         "region_name").collect()}
        b = {r["i"]: r["s"] for r in ml.label_encode(df, ["s"]).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == ref
    assert a == b
    vals = np.arange(1000, dtype=float)
    qdf = spark.createDataFrame([(float(v),) for v in vals], "x double")
    st = Q.column_stats(qdf, ["x"])
    monkeypatch.setattr(Q, "BROADCAST_MAX", 0)
    monkeypatch.setattr(Q, "FINAL_MAX", 10)
    monkeypatch.setattr(Q, "BINS", 8)
    got_q = Q.quantiles(qdf, ["x"], [0.3, 0.5], st)
    assert got_q[("x", 0.5)] == float(np.quantile(vals, 0.5))
    assert got_q[("x", 0.3)] == pytest.approx(float(np.quantile(vals, 0.3)))


def test_quantiles_with_infinities(spark, monkeypatch):
    monkeypatch.setattr(Q, "FINAL_MAX", 5)
    monkeypatch.setattr(Q, "BINS", 4)
    vals = [float("-inf"), float("inf")] + [float(i) for i in range(40)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    st = Q.column_stats(df, ["x"])
    got = Q.quantiles(df, ["x"], [0.0, 0.5, 1.0], st)
    assert got[("x", 0.0)] == float("-inf") and got[("x", 1.0)] == float("inf")
    assert got[("x", 0.5)] == float(np.quantile(np.array(vals), 0.5))
