"""Streaming state across runs, and a session walkthrough smoke run."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF0001
from tabsmith.operators import querylog as ql
from tabsmith.plans.sessions import QUICK_CHIPS, run_session
from tabsmith.sources import fixtures as fx
from tabsmith.streaming import querylog_stream as qs


def test_stream_state_accumulates(spark):
    conv = spark.read.parquet(f"{SF0001}/conversations.parquet")
    src = tempfile.mkdtemp(prefix="tabsmith-stream-src-")
    work = tempfile.mkdtemp(prefix="tabsmith-stream-work-")
    conv.filter(F.col("turn") <= 2).write.parquet(os.path.join(src, "part1"))
    ckpt, out = os.path.join(work, "ckpt"), os.path.join(work, "out")

    def run():
        routed = qs.routed_stream(qs.user_turns_stream(spark, os.path.join(src, "*")))
        qs.run_to_table(qs.sessions_stream(routed), out, ckpt)
        return {r["conv_id"]: r["total_turns"] for r in spark.read.parquet(out).collect()}

    first = run()
    conv.filter(F.col("turn") > 2).write.parquet(os.path.join(src, "part2"))
    second = run()                       # same checkpoint: only the new file is read
    expected = {r["conv_id"]: r["n"] for r in conv.filter(F.col("role") == "user")
                .groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert second == expected
    assert sum(first.values()) < sum(second.values())


def test_stream_matches_batch_routing(spark):
    path = f"{SF0001}/conversations.parquet"
    streamed = {(r["agent"], r["method"]): r["n"]
                for r in qs.stream_aggregate(spark, path, "diagnostics").collect()}
    batch = {(r["agent"], r["method"]): r["n"]
             for r in ql.routing_diagnostics(ql.route(fx.query_log(spark, SF0001))).collect()}
    assert streamed == batch


def test_quick_chips_walkthrough(spark):
    df = fx.dirty_lineitem(spark, SF0001)
    rows = run_session(df, QUICK_CHIPS, "dirty").orderBy("step").collect()
    assert [r["agent"] for r in rows] == ["analysis_agent", "cleaning_agent",
                                          "visualization_agent", "ml_agent"]
    assert rows[1]["tools"] == "cleaning_report,fill_missing_mean"
    assert "AutoML Results" in rows[3]["output"]


def test_write_turns_appends(spark):
    log = spark.createDataFrame([(1, 0, "hello", "hi"), (1, 2, "show missing values", "ok")],
                                "conv_id long, turn long, query string, output string")
    recs = ql.append_turn(ql.conversation_turns(log), "demo", 2, 4)
    path = os.path.join(tempfile.mkdtemp(prefix="tabsmith-turns-"), "t")
    ql.write_turns(recs, path)
    ql.write_turns(recs, path)
    assert spark.read.parquet(path).count() == 4


def test_random_split_and_model_save(spark):
    from tabsmith.operators import automl as ml
    df = fx.ml_class_rule(spark, SF0001)
    tagged = df.withColumn("s", ml.random_split_expr(42)).persist()
    share = tagged.filter("s = 'train'").count() / tagged.count()
    assert 0.7 < share < 0.9
    r = ml.auto_train(df, "level", split_key=F.col("event_id") * 7919, ids=("event_id",), cv=False)
    path = ml.save_model(r, os.path.join(tempfile.mkdtemp(prefix="tabsmith-model-"), "best"))
    assert os.path.isdir(path)


def test_session_results_are_the_operators_rows(spark):
    import json

    from tabsmith.operators import profile
    from tabsmith.plans.sessions import session_results, session_tables
    df = fx.dirty_lineitem(spark, SF0001)
    transcript, results = session_tables(df, QUICK_CHIPS[:2] + ["explain that"], "dirty")
    got = [json.loads(r["result"]) for r in results.filter("step = 1 and tool = 'dataset_summary'").collect()]
    want = [json.loads(x) for x in profile.dataset_summary(df).toJSON().collect()]
    assert sorted(got, key=json.dumps) == sorted(
        [{k: w.get(k) for k in got[0]} for w in want], key=json.dumps) and got
    counted = {(r["step"], x["tool"], x["part"]): x["rows"] for r in transcript.collect() for x in r["results"]}
    assert counted == {(r["step"], r["tool"], r["part"]): r["count"]
                       for r in results.groupBy("step", "tool", "part").count().collect()}
    assert {"step", "query", "output", "tool", "part", "result"} <= set(
        session_results(df, ["explain that"], "dirty").columns)
    words = session_results(df, ["explain that"], "dirty").collect()
    assert len(words) == 1 and words[0]["tool"] is None
