"""The session memory (QL8-QL11) as arbitrary stateful streaming.

Chat rows (conv_id, turn, role, text) arrive as a stream. Routing is a set of
column expressions, so it runs on the JVM before the state; what depends on the
conversation's history (turn numbers, whether an explain turn has a previous
output, the last turns, the last model result) is kept per conversation by
``applyInPandasWithState``. Every update writes a new version of the
conversation's memory, so the output is an append-only table in which the
latest version of each conversation is current; no batch rewrites the others.

Defined cases:

* rows of one conversation may arrive in any order within a micro-batch, and
  late by up to ``n`` user turns: turns are ordered by ``turn``, not by arrival;
* a reply belongs to the user turn just before it (``turn - 1``), whether it comes
  in the same micro-batch, later, or earlier;
* a repeated user turn still in memory is ignored, a repeated reply replaces the first;
* a null text is an empty output; a null query leaves its context line out;
* rows without a conversation or a turn, and other roles, are left out;
* with ``expire_after`` an idle conversation is closed: a last version with
  ``closed`` is written, its state dropped, and later rows start a new session.

State is bounded: the last ``n + 1`` turns, ``n`` replies without a turn, the
set of agents and one model result. A task holds one conversation's rows of one
micro-batch, which ``max_files`` bounds.
"""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tabsmith.functions import rules as R
from tabsmith.operators import querylog as ql
from tabsmith.session import scratch_path, ship_package
from tabsmith.sources.tables import stream_parquet

MEMORY = ("version bigint, closed boolean, total_turns bigint, agents_used string, dataset string, "
          "has_ml_results boolean, last_agent string, last_output string, last_ml_result string, "
          "explanation_context string, context string")
STATE = "memory string"
MAX_FILES = 16


def chat_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    """The rows of a conversations source (a folder of Parquet files, or one
    file) as a stream of at most ``max_files`` files a micro-batch."""
    return stream_parquet(spark, path, max_files).select("conv_id", "turn", "role", "text")


def routed_rows(rows: DataFrame) -> DataFrame:
    """Chat rows with the routing of user rows: the agent given that there is
    a previous output (the state settles the other case), whether the turn
    explains, and whether it trains models."""
    rows = rows.filter(F.col("role").isin("user", "assistant")
                       & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    routed = ql.fallback_tools(ql.route(rows, "text"), "agent", "text")
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    trains = ((F.col("intent") == "run_tool") & ~low.contains(R.OUTLIER_KEYWORD)
              & F.array_contains("tools", R.TRAIN_TOOL))
    return routed.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "agent",
                         (F.col("intent") == "explain").alias("explains"),
                         F.coalesce(trains, F.lit(False)).alias("trains"))


def _new() -> dict:
    return {"version": 0, "total": 0, "agents": [], "before": False, "trained": False,
            "ml_turn": None, "ml": None, "turns": [], "replies": {}}


def _learn(mem: dict, rows: pd.DataFrame, n: int) -> None:
    """Bring one micro-batch's rows of a conversation into its memory."""
    replies = {int(k): v for k, v in mem["replies"].items()}
    said = rows[rows["role"] == "assistant"]
    replies.update((int(t), x or "") for t, x in zip(said["turn"], said["text"]))
    turns = {t["turn"]: t for t in mem["turns"]}
    asked = rows[rows["role"] == "user"]
    for t, q, agent, explains, trains in zip(asked["turn"], asked["text"], asked["agent"],
                                             asked["explains"], asked["trains"]):
        if int(t) not in turns:
            turns[int(t)] = {"turn": int(t), "query": q, "agent": agent, "explains": bool(explains),
                             "trains": bool(trains), "output": ""}
            mem["total"] += 1
    for t in turns.values():
        t["output"] = replies.pop(t["turn"] + 1, t["output"])
        mem["trained"] |= t["trains"]
        if t["trains"] and t["output"] and (mem["ml_turn"] is None or t["turn"] >= mem["ml_turn"]):
            mem["ml_turn"], mem["ml"] = t["turn"], t["output"]
    ordered = [turns[k] for k in sorted(turns)]
    old, kept = ordered[:-(n + 1)], ordered[-(n + 1):]
    agents = set(mem["agents"])
    for t in old:                       # an agent is final once its turn leaves the memory
        agents.add(_agent(t, mem["before"]))
        mem["before"] = t["output"] != ""
    mem["agents"], mem["turns"] = sorted(agents), kept
    mem["replies"] = {str(k): replies[k] for k in sorted(replies)[-n:]}


def _agent(turn: dict, has_previous: bool) -> str:
    return "memory" if turn["explains"] and not has_previous else turn["agent"]


def _block(number: int, turn: dict, agent: str, snippet: int, dataset: str, shape: tuple) -> str:
    out = turn["output"]
    preview = ("[chart/figure generated]" if agent == "visualization_agent" else
               out[:snippet].replace("\n", " ") + ("..." if len(out) > snippet else ""))
    lines = [f"\n[Turn {number} | None]"]
    if turn["query"] is not None:
        lines.append(f"  User asked : {turn['query']}")
    return "\n".join(lines + [f"  Agent used : {agent}", f"  Output     : {preview}",
                              f"  Dataset    : {dataset} ({shape[0]}, {shape[1]})"])


def _render(mem: dict, n: int, snippet: int, dataset: str, shape: tuple, closed: bool) -> dict:
    agents, has_previous, blocks = set(mem["agents"]), mem["before"], []
    first = mem["total"] - len(mem["turns"]) + 1
    last, agent = None, None
    for number, last in enumerate(mem["turns"], start=first):
        agent = _agent(last, has_previous)
        agents.add(agent)
        blocks.append(_block(number, last, agent, snippet, dataset, shape))
        has_previous = last["output"] != ""
    context = f"Session so far ({mem['total']} total turns):\n" + "\n".join(blocks[-n:])
    if mem["ml"]:
        context += "\n\nLast ML result: " + mem["ml"]
    out = last["output"] if last else ""
    return {"version": mem["version"], "closed": closed, "total_turns": mem["total"],
            "agents_used": ",".join(sorted(agents)), "dataset": dataset, "has_ml_results": mem["trained"],
            "last_agent": agent, "last_output": out, "last_ml_result": mem["ml"],
            "explanation_context": out or R.NO_PREVIOUS_OUTPUT, "context": context}


def memory_stream(rows: DataFrame, dataset: str, shape: tuple = (0, 0), n: int = 6, snippet: int = 300,
                  expire_after: int | None = None) -> DataFrame:
    """One new version of the memory of every conversation that a micro-batch
    touches (or, with ``expire_after`` milliseconds, that it finds idle)."""
    ship_package(rows.sparkSession)
    key = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id"] + [part.split()[0] for part in MEMORY.split(", ")]

    def remember(conv, chunks, state):
        mem = json.loads(state.get[0]) if state.exists else _new()
        closed = state.hasTimedOut
        if not closed:
            parts = list(chunks)
            if parts:
                _learn(mem, pd.concat(parts, ignore_index=True), n)
        mem["version"] += 1
        if closed:
            state.remove()
        else:
            state.update((json.dumps(mem),))
            if expire_after is not None:
                state.setTimeoutDuration(expire_after)
        if mem["total"]:                # replies alone are no turn yet
            yield pd.DataFrame([{"conv_id": conv[0]} | _render(mem, n, snippet, dataset, shape, closed)],
                               columns=names)

    timeout = (GroupStateTimeout.NoTimeout if expire_after is None
               else GroupStateTimeout.ProcessingTimeTimeout)
    return routed_rows(rows).groupBy("conv_id").applyInPandasWithState(
        remember, f"conv_id {key}, {MEMORY}", STATE, "update", timeout)


def run_memory(memory: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None):
    """Start the stream. Each micro-batch writes its versions to its own folder
    of ``out_path``, so a batch repeated after a failure replaces itself.

    By default all rows there now are read and the call returns. ``trigger`` gives
    other trigger options; with ``processingTime`` the running query is returned.
    A stream that expires conversations always has another batch to plan, so it
    never ends on ``availableNow``: give it ``once`` or ``processingTime``."""
    trigger = trigger or {"availableNow": True}

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_path, f"epoch={epoch}"))

    w = memory.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    q = w.trigger(**trigger).start()
    if "processingTime" not in trigger:
        q.awaitTermination()
    return q


def current_memory(spark: SparkSession, out_path: str, conv_type: str = "bigint") -> DataFrame:
    """The latest version of every conversation's memory."""
    names = [part.split()[0] for part in MEMORY.split(", ")]
    table = spark.read.schema(f"conv_id {conv_type}, {MEMORY}, epoch bigint").parquet(out_path)
    latest = table.groupBy("conv_id").agg(F.max_by(F.struct(*names), "epoch").alias("m"))
    return latest.select("conv_id", "m.*")


def stream_memory(spark: SparkSession, source: str, dataset: str, rows: int, cols: int) -> DataFrame:
    """Run the memory over all of ``source`` and read the current versions."""
    base = scratch_path(spark, "stream-memory")
    chat = chat_stream(spark, source)
    out = os.path.join(base, "versions")
    run_memory(memory_stream(chat, dataset, (rows, cols)), out, os.path.join(base, "checkpoint"))
    return current_memory(spark, out, chat.schema["conv_id"].dataType.simpleString())
