"""The streamed session memory: equal to the batch operators however the rows arrive."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from conftest import SF0001
from tabsmith.operators import querylog as ql
from tabsmith.streaming import session_memory as sm

SCHEMA = "conv_id long, turn int, role string, text string"
SESSION = [
    (1, 0, "user", "explain that"), (1, 1, "assistant", "nothing yet"),
    (1, 2, "user", "train a model"), (1, 3, "assistant", "Accuracy 0.9\nbest: forest"),
    (1, 4, "user", "explain that"), (1, 5, "assistant", ""),
    (1, 6, "user", "what does it mean"), (1, 7, "assistant", "x" * 301),
    (1, 8, "user", "plot a histogram"), (1, 9, "assistant", "a chart"),
    (1, 10, "user", "show missing values"), (1, 11, "assistant", None),
    (1, 12, "user", "summary"), (1, 13, "assistant", "rows 3\ncols 4"),
    (1, 14, "user", "remove outliers and train"), (1, 15, "assistant", "removed 2"),
    (2, 0, "user", "hello"),
    (3, 0, "user", "train models"), (3, 1, "assistant", ""),
    (4, 0, "assistant", "a reply without a question"), (5, 0, "system", "ignored"),
]


def _batch(df):
    users = df.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    replies = df.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("output"))
    turns = ql.conversation_turns(users.join(replies, ["conv_id", "turn"], "left"))
    ml = ql.ml_results(turns)
    context = ql.recent_context(ql.append_turn(turns, "chat", 9, 4), ml_results=ml)
    out = (ql.session_summary(turns, "chat").join(ql.last_output(turns, ml).drop("last_agent"), "conv_id")
           .join(context, "conv_id"))
    return {r["conv_id"]: (r["total_turns"], r["agents_used"], r["dataset"], r["has_ml_results"], r["last_agent"],
                           r["last_output"], r["last_ml_result"], r["explanation_context"], r["context"])
            for r in out.collect()}


class Stream:
    def __init__(self, spark, **options):
        self.spark, self.options = spark, options
        self.src, work = (tempfile.mkdtemp(prefix="tabsmith-memory-") for _ in range(2))
        self.out, self.ckpt = os.path.join(work, "out"), os.path.join(work, "ckpt")

    def feed(self, df):
        df.coalesce(1).write.mode("append").parquet(self.src)
        sm.run_memory(sm.memory_stream(sm.chat_stream(self.spark, self.src), "chat", (9, 4), **self.options),
                      self.out, self.ckpt, {"once": True} if "expire_after" in self.options else None)

    def now(self):
        return {r["conv_id"]: (r["total_turns"], r["agents_used"], r["dataset"], r["has_ml_results"],
                               r["last_agent"], r["last_output"], r["last_ml_result"],
                               r["explanation_context"], r["context"])
                for r in sm.current_memory(self.spark, self.out).collect()}


def test_memory_equals_batch_in_one_go(spark):
    df = spark.createDataFrame(SESSION, SCHEMA)
    s = Stream(spark)
    s.feed(df)
    want = _batch(df)
    assert s.now() == want
    assert want[1][3] and want[1][6].startswith("Accuracy") and want[3][3] and want[3][6] is None
    assert "memory" in want[1][1].split(",") and set(want) == {1, 2, 3}


def test_late_early_and_repeated_rows(spark):
    df = spark.createDataFrame(SESSION, SCHEMA)
    s = Stream(spark)
    s.feed(df.filter("turn in (3, 6, 4)"))                      # a reply before its question
    s.feed(df.filter("turn in (0, 2, 5, 6)"))                   # earlier turns come late, one again
    s.feed(df.filter("turn in (1, 7, 8, 9)"))
    s.feed(df.filter("turn >= 10"))
    assert s.now() == _batch(df)
    versions = spark.read.parquet(s.out).filter("conv_id = 1")
    assert [r["version"] for r in versions.orderBy("version").collect()] == [1, 2, 3, 4]


def test_long_conversation_over_many_batches(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant",
             ["train it", "explain that", "plot it", "clean duplicates"][i // 2 % 4] if i % 2 == 0
             else "" if i % 10 == 1 else f"answer {i}") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    s = Stream(spark)
    for a in range(0, 200, 67):
        s.feed(df.filter(F.col("turn").between(a, a + 66)))
    assert s.now() == _batch(df)


def test_idle_conversations_are_closed(spark):
    df = spark.createDataFrame(SESSION, SCHEMA)
    s = Stream(spark, expire_after=1)
    s.feed(df.filter("conv_id = 1"))
    time.sleep(0.1)
    s.feed(df.filter("conv_id = 2"))
    latest = {r["conv_id"]: (r["closed"], r["total_turns"]) for r in sm.current_memory(spark, s.out).collect()}
    assert latest[1] == (True, 8) and latest[2][1] == 1
    s.feed(df.filter("conv_id = 1 and turn >= 14"))             # a new session after the end
    assert s.now()[1][0] == 1


def test_given_table(spark):
    path = f"{SF0001}/conversations.parquet"
    got = sm.stream_memory(spark, path, "chat", 9, 4)
    want = _batch(spark.read.parquet(path).select("conv_id", "turn", "role", "text"))
    assert {r["conv_id"]: r["context"] for r in got.collect()} == {k: v[-1] for k, v in want.items()}


def test_empty_table(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tabsmith-memory-"), "c.parquet")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(path)
    s = Stream(spark)
    s.feed(spark.createDataFrame([], SCHEMA))
    assert s.now() == {}


def test_a_table_is_one_file_or_a_folder_of_that_name(spark, tmp_path):
    """conversations.parquet as a folder of files, and as a file beside another folder's file of its name."""
    rows = spark.createDataFrame(SESSION, SCHEMA)
    want = _batch(rows)
    folder = str(tmp_path / "many" / "conversations.parquet")
    rows.repartition(3).write.parquet(folder)
    single, other = str(tmp_path / "one" / "conversations.parquet"), str(tmp_path / "one" / "old" / "conversations.parquet")
    rows.toPandas().to_parquet(os.path.join(_made(os.path.dirname(single)), "conversations.parquet"))
    rows.withColumn("conv_id", F.col("conv_id") + 100).toPandas().to_parquet(
        os.path.join(_made(os.path.dirname(other)), "conversations.parquet"))
    for path in (folder, single):
        got = sm.stream_memory(spark, path, "chat", 9, 4)
        assert {r["conv_id"]: (r["total_turns"], r["last_output"], r["context"]) for r in got.collect()} == {
            k: (v[0], v[5], v[8]) for k, v in want.items()}


def _made(folder):
    os.makedirs(folder)
    return folder
