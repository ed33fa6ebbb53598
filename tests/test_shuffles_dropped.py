"""A session's finished queries leave no shuffle files behind, and rows stay the same."""

import os

from pyspark.sql import functions as F

from tabsmith import session as se
from tabsmith.plans import sessions


def _shuffle_files(spark):
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {n for d in root for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_shuffle_files_go_with_their_query(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("k")).groupBy("k").count()
    before = _shuffle_files(spark)
    with se.shuffles_dropped(spark):
        assert df.agg(F.sum("count")).first()[0] == 20_000
        left = _shuffle_files(spark) - before
        frame = df.filter("count > 1")
        assert frame.count() == 5000 and len(frame.collect()) == len(frame.collect()) == 5000     # run again: made anew
    assert not left
    assert spark.conf.get(se.SHUFFLE_CLEANUP_CONF, None) != "true"


def test_sessions_drop_them(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sessions, "route_questions", lambda s, q: seen.append(s.conf.get(se.SHUFFLE_CLEANUP_CONF)) or [])
    sessions.run_session(spark.range(10).select("id"), ["Summarize the dataset"])
    assert seen == ["true"]
