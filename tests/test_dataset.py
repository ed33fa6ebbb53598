"""Dataset helpers: change detection, preview order, JSON records."""

import json

from tabsmith.sources import dataset as ds


def test_frames_differ_paths(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    same = ds.frames_differ(a, a.orderBy("v")).first()
    assert (same["differs"], same["only_in_a"], same["only_in_b"]) == (False, 0, 0)
    dedup = ds.frames_differ(a, a.dropDuplicates()).first()
    assert (dedup["differs"], dedup["only_in_a"], dedup["only_in_b"]) == (True, 1, 0)
    other = ds.frames_differ(a, a.withColumnRenamed("v", "w")).first()
    assert other["differs"] is True


def test_preview_and_records(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k long, v string")
    assert [r["k"] for r in ds.preview(df, 2, ["k"]).collect()] == [1, 2]
    recs = [json.loads(r["record"]) for r in ds.records_json(df, 2, ["k"]).collect()]
    assert recs == [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]
    cols = ds.column_list(df).collect()
    assert [(r["column"], r["type"]) for r in cols] == [("k", "bigint"), ("v", "string")]
