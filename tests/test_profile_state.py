"""Kept and merged profiles against full ones; digests of frames."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF0001
from tabsmith.functions.digest import frame_digest
from tabsmith.operators import profile, profile_state as ps
from tabsmith.session import scratch_path
from tabsmith.sources import dataset as ds
from tabsmith.sources import fixtures as fx


def test_digest_of_equal_and_unlike_frames(spark):
    schema = "a long, b long, c array<long>, d array<long>, e double, m map<string,long>"
    rows = [(1, None, [1, 2], [], 0.0, {"x": 1, "y": 2}), (1, None, [1, 2], [], 0.0, {"x": 1, "y": 2}), (3, 4, None, [None, 1], None, None)]
    df = spark.createDataFrame(rows, schema)
    turned = spark.createDataFrame([rows[2], (1, None, [1, 2], [], -0.0, {"y": 2, "x": 1}), rows[0]], schema).repartition(3)
    base = frame_digest(df)
    assert base == frame_digest(turned) and base[0] == 3
    for k, row in [(0, (None, 1, *rows[0][2:])), (0, (1, None, [1], [2], 0.0, {"x": 1, "y": 2})),
                   (2, (3, 4, None, [1, None], None, None)), (0, rows[2])]:
        other = [*rows]
        other[k] = row
        assert frame_digest(spark.createDataFrame(other, schema)) != base
    assert frame_digest(df.limit(0))[0] == 0


def test_equal_frames_shuffle_no_rows(spark):
    a = fx.dirty_lineitem(spark, SF0001)
    got = ds.frames_differ(a, a.repartition(7)).first()
    assert (got.differs, got.rows_a, got.rows_b, got.only_in_a, got.only_in_b) == (False, a.count(), a.count(), 0, 0)
    b = a.limit(0)
    got = ds.frames_differ(a, b).first()
    assert got.differs and got.only_in_a == a.count() and got.only_in_b == 0


def test_nunique_of_all_kinds_of_columns(spark):
    long = "x" * 100
    rows = [(1, 0.0, "a", [1, None], None, bytearray(b"z" * 40)), (1, -0.0, long + "1", [None, 1], None, bytearray(b"z" * 41)),
            (2, None, long + "2", [1], None, None), (2, 0.1, "a", [1], None, bytearray(b"z" * 40))]
    df = spark.createDataFrame(rows, "i int, f double, s string, l array<int>, n string, b binary").withColumn(
        "t", F.timestamp_seconds(F.col("i") * 10 ** 9))
    got = {r["column"]: r.nunique for r in profile.nunique(df).collect()}
    assert got == {"i": 2, "f": 2, "s": 3, "l": 3, "n": 0, "b": 2, "t": 2}
    assert profile.nunique(df.limit(0)).where("nunique > 0").count() == 0


def test_merged_states_equal_one_state_and_keep_their_error_bounds(spark):
    rng = np.random.default_rng(5)
    n = 40_000
    skewed = np.exp(rng.normal(0, 3, n))
    tied = np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 30, n)).astype(float)
    far = 1e9 + rng.normal(0, 1e-3, n) + (np.arange(n) % 50)
    df = spark.createDataFrame([(int(i % 50), i, float(a), float(b), float(c), f"v{i % 900}")
                                for i, (a, b, c) in enumerate(zip(skewed, tied, far))],
                               "part int, id long, skewed double, tied double, far double, word string").repartition(6)
    parts = ps.column_states(df, ("part",))
    assert parts.count() == 50 * 5
    got = {r["column"]: r for r in ps.describe_states(ps.merge_states(parts)).collect()}
    for name, x in (("skewed", skewed), ("tied", tied), ("far", far)):
        r = got[name]
        assert r["rows"] == r["count"] == n and (r["min"], r["max"]) == (x.min(), x.max())
        assert abs(r["mean"] / x.mean() - 1) < 1e-12 and abs(r["std"] / x.std(ddof=1) - 1) < 1e-9
        order = np.sort(x)
        for q, v in ((0.25, r.p25), (0.5, r.p50), (0.75, r.p75)):
            low, high = np.searchsorted(order, v, "left") / n, np.searchsorted(order, v, "right") / n
            assert low - 2 * ps.RANK_ERROR <= q <= high + 2 * ps.RANK_ERROR
    assert abs(got["id"].distinct / n - 1) < 4 * ps.DISTINCT_ERROR and abs(got["word"].distinct / 900 - 1) < 4 * ps.DISTINCT_ERROR
    assert got["word"]["mean"] is None and got["word"].p50 is None and got["word"]["count"] == n


def test_states_of_groups_roll_up(spark):
    ev = fx.events(spark, SF0001).withColumn("day", F.to_date("ts")).select("event_type", "day", "value")
    fine = ps.column_states(ev, ("event_type", "day"))
    up = {r.event_type: r for r in ps.describe_states(ps.merge_states(fine, ("event_type",))).collect()}
    want = {r.event_type: r for r in ev.groupBy("event_type").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).collect()}
    assert up.keys() == want.keys()
    for k, w in want.items():
        assert up[k]["count"] == w.n and abs(up[k]["mean"] - w.m) < 1e-9 and abs(up[k]["std"] - w.s) < 1e-9


def test_missing_cells_empty_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, None, None), (float("nan"), None, "a")], "x double, y double, s string")
    got = {r["column"]: r for r in ps.describe_states(ps.merge_states(ps.column_states(df))).collect()}
    assert (got["x"]["count"], got["x"]["mean"], got["x"]["std"], got["x"].p50) == (1, 1.0, None, 1.0)
    assert (got["y"]["count"], got["y"]["mean"], got["y"].p50, got["y"].distinct) == (0, None, None, 0)
    none = ps.describe_states(ps.merge_states(ps.column_states(df.limit(0)))).collect()
    assert [(r["rows"], r["count"], r.p25) for r in none] == [(0, 0, None)] * 3


def test_a_new_version_reads_new_files_alone(spark):
    all_rows = fx.dirty_lineitem(spark, SF0001)
    third = F.pmod("l_orderkey", F.lit(3))
    root = scratch_path(spark, "profile")
    kept = ps.VersionProfile(spark, root)
    v1 = ds.save_version(ds.as_dataset(all_rows, "li"), all_rows.where(third == 0).repartition(3))
    assert kept.update(v1) == 3 and kept.update(v1) == 0
    v2 = ds.append_version(v1, all_rows.where(third == 1).repartition(2))
    v3 = ds.append_version(v2, all_rows.where(third == 2).repartition(2))
    assert v3.version == 3 and ds.frames_differ(v3.df, all_rows).first().differs is False
    assert kept.update(v2) == 2
    got = kept.profile(v3).orderBy("ordinal").collect()
    assert kept._read("commits", "file string, run string").count() == 7
    full = profile.dataset_summary(all_rows).orderBy("ordinal").collect()
    for g, w in zip(got, full, strict=True):
        assert all(g[c] == w[c] for c in ("ordinal", "column", "dtype", "missing", "missing_pct", "n_rows", "n_columns",
                                          "duplicate_rows"))
    described = {r["column"]: r for r in profile.describe_statistics(all_rows).collect()}
    for g in got:
        if g["column"] in described:
            w = described[g["column"]]
            assert g["count"] == w["count"] and all(abs(g[c] - w[c]) < 1e-3 for c in ("mean", "std", "min", "max"))
    # an earlier version still has its own profile, from what is kept
    first = kept.profile(v1).first()
    assert first.n_rows == v1.df.count()
    # an update that counted twice counts once; one that failed before its commit does not count
    for name in ("states", "hashes"):
        spark.read.parquet(f"{root}/{name}").drop("run").write.parquet(f"{root}/{name}/run=r-failed")
    assert kept.profile(v3).orderBy("ordinal").first().n_rows == all_rows.count()


def test_an_empty_version(spark):
    df = spark.createDataFrame([], "a long, file string")
    kept = ps.VersionProfile(spark, scratch_path(spark, "profile"))
    v1 = ds.save_version(ds.as_dataset(df, "none"), df)
    got = kept.profile(v1).orderBy("ordinal").collect()
    assert [(r["column"], r.n_rows, r["count"], r.duplicate_rows, r.missing_pct) for r in got] == [
        ("a", 0, 0, 0, None), ("file", 0, 0, 0, None)]
    v2 = ds.append_version(v1, spark.createDataFrame([(1, "x"), (1, "x")], "a long, file string"))
    assert [(r.n_rows, r.duplicate_rows) for r in kept.profile(v2).collect()] == [(2, 1)] * 2
