"""Registered query-log queries over the ``conversations`` table (every user
turn is a query, the following assistant turn its output)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators import querylog as ql
from tabsmith.sources import fixtures as fx
from tabsmith.sources.tables import load_table

SESSION_DATASET = "conversations"


def prompt_schema_text(columns: list[str], rows: str = "Unknown", max_cols: int = 10) -> str:
    """The schema block the router compares query words against (rows are
    reported as the router saw them)."""
    shown = columns[:max_cols] + ([f"... and {len(columns) - max_cols} more"]
                                  if len(columns) > max_cols else [])
    return ("\nDATASET DETAILS:\n\nColumns: " + ", ".join(shown)
            + f"\n\nTotal Rows: {rows}\nTotal Columns: {len(columns)}\n\n"
            "IMPORTANT RULES:\n- Always use ONLY these column names\n"
            "- Do NOT assume dataset structure\n- Match user query words with column names\n")


LINEITEM_SCHEMA_TEXT = prompt_schema_text(
    ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
     "l_returnflag", "l_linestatus"])


def _qlog(spark, sf):
    return fx.query_log(spark, sf)


def _turns(spark, sf):
    return ql.conversation_turns(fx.turn_log(spark, sf))


def q_classify_intent(spark: SparkSession, sf: str) -> DataFrame:
    return ql.classify_intent(_qlog(spark, sf)).select("conv_id", "turn", "intent")


def q_agent_scores(spark, sf):
    return ql.agent_scores(_qlog(spark, sf)).drop("query")


def q_schema_term_override(spark, sf):
    return (ql.schema_term_override(_qlog(spark, sf), LINEITEM_SCHEMA_TEXT)
              .select("conv_id", "turn", "schema_override"))


def q_outlier_override(spark, sf):
    return ql.outlier_override(_qlog(spark, sf)).drop("query")


def _routed(spark, sf):
    return ql.route(_qlog(spark, sf))


def q_fallback_tools(spark, sf):
    r = ql.fallback_tools(_routed(spark, sf))
    return r.select("conv_id", "turn", "agent", F.array_join("tools", ",").alias("tools"))


def q_rule_tool(spark, sf):
    return ql.rule_tool(_routed(spark, sf)).select("conv_id", "turn", "agent", "rule_tool")


def q_final_tool(spark, sf):
    r = ql.final_tool(ql.rule_tool(_routed(spark, sf)))
    return r.select("conv_id", "turn", "agent", "final_tool")


def _records(spark, sf, turns):
    rows = load_table(spark, sf, SESSION_DATASET).count()
    return ql.append_turn(turns, SESSION_DATASET, rows, 4)


def q_append_turn(spark, sf):
    return (_records(spark, sf, _turns(spark, sf))
            .withColumn("dataset_rows", F.col("dataset_shape.rows"))
            .withColumn("dataset_cols", F.col("dataset_shape.cols"))
            .drop("dataset_shape"))


def q_recent_context(spark, sf):
    turns = _turns(spark, sf)
    return ql.recent_context(_records(spark, sf, turns), ml_results=ql.ml_results(turns))


def q_session_summary(spark, sf):
    return ql.session_summary(_turns(spark, sf), SESSION_DATASET)


def q_last_output(spark, sf):
    turns = _turns(spark, sf)
    return ql.last_output(turns, ql.ml_results(turns))


def q_explain_rules(spark, sf):
    return ql.explain_rules(_turns(spark, sf))


def q_insight_rules(spark, sf):
    return ql.insight_rules(_turns(spark, sf))


def q_response_label(spark, sf):
    return ql.response_label(_turns(spark, sf))


def q_routing_diagnostics(spark, sf):
    return ql.routing_diagnostics(_turns(spark, sf))


def q_stream_routing_diagnostics(spark, sf):
    """QL15 computed by a Structured Streaming query over the conversations files."""
    from tabsmith.sources.tables import table_path
    from tabsmith.streaming.querylog_stream import stream_aggregate
    return stream_aggregate(spark, table_path(sf, "conversations"), "diagnostics")


def _stream_memory(spark, sf):
    from tabsmith.sources.tables import table_path
    from tabsmith.streaming.session_memory import stream_memory
    rows = load_table(spark, sf, SESSION_DATASET).count()
    return stream_memory(spark, table_path(sf, SESSION_DATASET), SESSION_DATASET, rows, 4)


def q_stream_session_summary(spark, sf):
    """QL10 per conversation, from the streamed session memory."""
    return _stream_memory(spark, sf).select("conv_id", "total_turns", "agents_used", "dataset",
                                            "has_ml_results", "last_agent")


def q_stream_recent_context(spark, sf):
    """QL9 per conversation, from the streamed session memory."""
    return _stream_memory(spark, sf).select("conv_id", "context")


def q_stream_last_output(spark, sf):
    """QL11 per conversation, from the streamed session memory."""
    return _stream_memory(spark, sf).select("conv_id", F.col("total_turns").alias("last_turn"), "last_output",
                                            "last_agent", "last_ml_result", "explanation_context")


def querylog_queries() -> dict:
    return {
        "classify_intent": q_classify_intent,
        "agent_scores": q_agent_scores,
        "schema_term_override": q_schema_term_override,
        "outlier_override": q_outlier_override,
        "fallback_tools": q_fallback_tools,
        "rule_tool": q_rule_tool,
        "final_tool": q_final_tool,
        "append_turn": q_append_turn,
        "recent_context": q_recent_context,
        "session_summary": q_session_summary,
        "last_output": q_last_output,
        "explain_rules": q_explain_rules,
        "insight_rules": q_insight_rules,
        "response_label": q_response_label,
        "routing_diagnostics": q_routing_diagnostics,
        "stream_routing_diagnostics": q_stream_routing_diagnostics,
        "stream_session_summary": q_stream_session_summary,
        "stream_recent_context": q_stream_recent_context,
        "stream_last_output": q_stream_last_output,
    }
