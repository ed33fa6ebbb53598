"""Structured Streaming over a growing table of chat turns.

The routing rules are stateless column expressions, so they apply to a
stream unchanged; routing diagnostics (QL15) and per-conversation session
summaries (QL10) become streaming aggregations whose state lives in Spark's
state store (checkpointed under the shared folder, so a restarted or
recovered query continues where it stopped). Each micro-batch writes the
complete aggregate to a Parquet table with ``foreachBatch``: no result
passes through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators import querylog as ql
from tabsmith.session import scratch_path
from tabsmith.sources.tables import stream_parquet


def user_turns_stream(spark: SparkSession, path: str) -> DataFrame:
    """User turns of a conversations source (a folder of Parquet files, or
    one file) as a stream."""
    return (stream_parquet(spark, path).filter(F.col("role") == "user")
            .select("conv_id", "turn", F.col("text").alias("query")))


def routed_stream(turns: DataFrame) -> DataFrame:
    """QL1-QL5 on each arriving turn (explain turns -> explain_memory)."""
    return ql.fallback_tools(ql.route(turns))


def diagnostics_stream(routed: DataFrame) -> DataFrame:
    """QL15 as a streaming aggregation."""
    return routed.groupBy("agent", "method").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def sessions_stream(routed: DataFrame) -> DataFrame:
    """QL10 (without the trained-model flag) as a streaming aggregation."""
    return routed.groupBy("conv_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_turns"),
        F.array_join(F.sort_array(F.collect_set("agent")), ",").alias("agents_used"),
        F.max_by("agent", "turn").alias("last_agent"))


def run_to_table(agg: DataFrame, out_path: str, checkpoint: str, available_now: bool = True,
                 name: str | None = None):
    """Start ``agg`` in complete mode; every batch overwrites the Parquet
    table at ``out_path``. With ``available_now`` the call returns once the
    current input is processed."""
    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    w = (agg.writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint))
    if name:
        w = w.queryName(name)
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
    return q


def stream_aggregate(spark: SparkSession, source: str, kind: str) -> DataFrame:
    """Run one streaming aggregation over ``source`` to completion and read
    its result table."""
    base = scratch_path(spark, f"stream-{kind}")
    routed = routed_stream(user_turns_stream(spark, source))
    agg = diagnostics_stream(routed) if kind == "diagnostics" else sessions_stream(routed)
    out = os.path.join(base, "table")
    run_to_table(agg, out, os.path.join(base, "checkpoint"))
    return spark.read.parquet(out)
