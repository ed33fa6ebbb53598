"""Query-log operators (QL1-QL15): the chat router's keyword rules and the
session memory, re-aimed at a table of chat turns.

Every rule is a narrow column expression (lower / contains / when /
coalesce): no UDF, no shuffle. Per-conversation work (turn numbering, the
previous turn, the last turns, summaries) uses pre-aggregated group-bys,
bounded windows and equi-joins on (conversation, turn), so a conversation
holding a large share of all turns is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions import rules as R
from tabsmith.functions.columns import col
from tabsmith.functions.positions import positions
from tabsmith.session import materialize


def _q(query: str) -> Column:
    return F.lower(F.coalesce(col(query), F.lit("")))


# ------------------------------------------------------------- routing

def classify_intent(log: DataFrame, query: str = "query") -> DataFrame:
    """QL1: explain / business_insight / run_tool by substring rules."""
    return log.withColumn("intent", R.intent_expr(_q(query)))


def agent_scores(log: DataFrame, query: str = "query") -> DataFrame:
    """QL2: keyword hits per agent and the winning agent (table order breaks
    ties; no hit -> analysis_agent)."""
    q = _q(query)
    scores = {a: R.hit_count(q, kws) for a, kws in R.AGENT_KEYWORDS.items()}
    out = log
    for a, s in scores.items():
        out = out.withColumn("score_" + a.replace("_agent", ""), s.cast("bigint"))
    cols = {a: F.col("score_" + a.replace("_agent", "")) for a in R.AGENT_KEYWORDS}
    return out.withColumn("agent", R.argmax_agent(cols))


def schema_term_override(log: DataFrame, schema_text: str, query: str = "query",
                         whole_words: bool = False) -> DataFrame:
    """QL3: True when a whitespace-separated token of the query occurs in the
    schema text (substring test, as the router does); ``whole_words`` tests
    tokens against the schema's words instead."""
    text = schema_text.lower()
    tokens = F.filter(F.split(_q(query), R.WHITESPACE_RUN), lambda t: t != "")
    if whole_words:
        words = F.array(*[F.lit(w) for w in sorted(set(text.split()))])
        hit = F.exists(tokens, lambda t: F.array_contains(words, t))
    else:
        hit = F.exists(tokens, lambda t: F.lit(text).contains(t))
    return log.withColumn("schema_override", hit)


def outlier_override(log: DataFrame, query: str = "query") -> DataFrame:
    """QL4: a query mentioning outliers goes straight to remove_outliers."""
    hit = _q(query).contains(R.OUTLIER_KEYWORD)
    return (log.withColumn("outlier_override", hit)
               .withColumn("override_agent", F.when(hit, R.OUTLIER_AGENT))
               .withColumn("override_tool", F.when(hit, R.OUTLIER_TOOL)))


def route(log: DataFrame, query: str = "query", schema_text: str = "",
          has_previous: str | None = None) -> DataFrame:
    """Offline routing of each turn: (intent, agent, used_fallback, method).

    explain -> explain_memory (memory when there is no previous output),
    business_insight -> business_insight, otherwise the outlier rule, the
    schema-term rule and the keyword scores in that order. The live router
    passes no schema text, so QL3 never fires there; ``schema_text`` turns it on.
    """
    q = _q(query)
    intent = R.intent_expr(q)
    scores = {a: R.hit_count(q, kws) for a, kws in R.AGENT_KEYWORDS.items()}
    keyword_agent = R.argmax_agent(scores)
    if schema_text:
        tokens = F.filter(F.split(q, R.WHITESPACE_RUN), lambda t: t != "")
        keyword_agent = F.when(F.exists(tokens, lambda t: F.lit(schema_text.lower()).contains(t)),
                               R.DEFAULT_AGENT).otherwise(keyword_agent)
    outlier = q.contains(R.OUTLIER_KEYWORD)
    explain_agent = (F.when(col(has_previous), "explain_memory").otherwise("memory")
                     if has_previous else F.lit("explain_memory"))
    agent = (F.when(intent == "explain", explain_agent)
              .when(intent == "business_insight", "business_insight")
              .when(outlier, R.OUTLIER_AGENT).otherwise(keyword_agent))
    fallback = ~((intent == "run_tool") & outlier) & (agent != "memory")
    return (log.withColumn("intent", intent).withColumn("agent", agent)
               .withColumn("used_fallback", fallback)
               .withColumn("method", F.when(F.col("used_fallback"), R.ROUTING_METHODS[1])
                                       .otherwise(R.ROUTING_METHODS[0])))


def fallback_tools(log: DataFrame, agent: str = "agent", query: str = "query") -> DataFrame:
    """QL5: tools the offline executor runs for the routed agent."""
    q = _q(query)
    return log.withColumn("tools", R.per_agent(col(agent), lambda a: R.fallback_tools_expr(q, a)))


def rule_tool(log: DataFrame, agent: str = "agent", query: str = "query") -> DataFrame:
    """QL6: the keyword rule's tool for the routed agent (NULL if none)."""
    q = _q(query)
    return log.withColumn("rule_tool", R.per_agent(col(agent), lambda a: R.rule_tool_expr(q, a)))


def final_tool(log: DataFrame, agent: str = "agent", rule: str = "rule_tool",
               llm: str | None = None) -> DataFrame:
    """QL7: rule and model agree -> it; conflict -> rule; else whichever
    exists; else the agent's first tool == coalesce(rule, model, first)."""
    first = R.per_agent(col(agent), lambda a: F.lit(R.AGENT_TOOLS[a][0]))
    model = col(llm) if llm else F.lit(None).cast("string")
    return log.withColumn("final_tool", F.coalesce(col(rule), model, first))


# ------------------------------------------------------------ turn log

def conversation_turns(log: DataFrame, conv: str = "conv_id", turn: str = "turn",
                       query: str = "query", output: str = "output") -> DataFrame:
    """Routed turn log: 1-based ``turn_id`` per conversation, the previous
    turn's output (equi-join on (conv, turn_id - 1)), intent, agent, the
    tools the offline executor runs and the fallback flag."""
    base = materialize(log.select(col(conv).alias("conv_id"), col(turn).alias("turn"),
                                  col(query).alias("query"),
                                  F.coalesce(col(output), F.lit("")).alias("output")))
    # numbered once, then read by the previous-turn self-join and all users
    t = materialize(positions(base, ["conv_id"], "turn", out="turn_id"))
    prev = t.select("conv_id", (F.col("turn_id") + 1).alias("turn_id"),
                    F.col("output").alias("prev_output"))
    t = t.join(prev, ["conv_id", "turn_id"], "left")
    t = t.withColumn("has_previous", F.coalesce(F.col("prev_output") != "", F.lit(False)))
    t = route(t, "query", has_previous="has_previous")
    run = F.col("intent") == "run_tool"
    outlier = _q("query").contains(R.OUTLIER_KEYWORD)
    tools = R.per_agent(F.col("agent"), lambda a: R.fallback_tools_expr(_q("query"), a))
    return (t.withColumn("tools", F.when(run & outlier, F.array(F.lit(R.OUTLIER_TOOL)))
                                    .when(run, tools))
             .withColumn("figure_generated", F.col("agent") == "visualization_agent"))


def append_turn(turns: DataFrame, dataset_name: str, rows: int, cols: int,
                ts: str | None = None) -> DataFrame:
    """QL8: memory records (turn_id, timestamp HH:mm:ss, user_query,
    agent_used, tool_output, figure_generated, dataset_name, dataset_shape,
    used_fallback)."""
    stamp = F.date_format(col(ts), "HH:mm:ss") if ts else F.lit(None).cast("string")
    return turns.select(
        "conv_id", "turn_id", stamp.alias("timestamp"), F.col("query").alias("user_query"),
        F.col("agent").alias("agent_used"), F.col("output").alias("tool_output"),
        "figure_generated", F.lit(dataset_name).alias("dataset_name"),
        F.struct(F.lit(rows).cast("bigint").alias("rows"),
                 F.lit(cols).cast("bigint").alias("cols")).alias("dataset_shape"),
        F.col("used_fallback"))


def write_turns(records: DataFrame, path: str) -> None:
    """QL8 sink: append memory records to a Parquet table (one append per
    batch of turns; readers see every committed batch)."""
    records.write.mode("append").parquet(path)


def recent_context(records: DataFrame, n: int = 6, snippet: int = 300,
                   ml_results: DataFrame | None = None) -> DataFrame:
    """QL9: per conversation the context text of its last ``n`` turns: a
    header with the total, then per turn the query, agent, output preview
    (figure marker, or the first ``snippet`` characters with newlines as
    spaces and "..." when longer) and the dataset. ``ml_results`` (conv_id,
    ml_result: its text) adds the last model's line where there is one.

    The records' ``turn_id`` runs from 1, so a conversation's total is its maximum."""
    totals = records.groupBy("conv_id").agg(F.max("turn_id").alias("total"))
    last = records.join(totals, "conv_id").filter(F.col("turn_id") > F.col("total") - n)
    out = F.col("tool_output")
    preview = F.when(F.col("figure_generated"), F.lit("[chart/figure generated]")).otherwise(
        F.concat(F.translate(F.substring(out, 1, snippet), "\n", " "),
                 F.when(F.length(out) > snippet, "...").otherwise("")))
    block = F.concat_ws(
        "\n",
        F.format_string("\n[Turn %d | %s]", F.col("turn_id"),
                        F.coalesce(F.col("timestamp"), F.lit("None"))),
        F.concat(F.lit("  User asked : "), F.col("user_query")),
        F.concat(F.lit("  Agent used : "), F.col("agent_used")),
        F.concat(F.lit("  Output     : "), preview),
        F.format_string("  Dataset    : %s (%d, %d)", F.col("dataset_name"),
                        F.col("dataset_shape.rows"), F.col("dataset_shape.cols")))
    per_conv = last.groupBy("conv_id").agg(
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("turn_id", block.alias("b")))).alias("blocks"))
    context = F.concat(F.format_string("Session so far (%d total turns):", F.col("total")), F.lit("\n"),
                       F.array_join(F.transform("blocks", lambda s: s["b"]), "\n"))
    if ml_results is not None:
        per_conv = per_conv.join(ml_results.select("conv_id", "ml_result"), "conv_id", "left")
        context = F.concat(context, F.coalesce(F.concat(F.lit("\n\nLast ML result: "), F.col("ml_result")), F.lit("")))
    return per_conv.select("conv_id", context.alias("context"))


def session_summary(turns: DataFrame, dataset_name: str = "dataset") -> DataFrame:
    """QL10: per conversation total turns, agents used (sorted), dataset,
    whether a model was trained, and the last agent."""
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_turns"),
        F.array_join(F.sort_array(F.collect_set("agent")), ",").alias("agents_used"),
        F.first(F.lit(dataset_name)).alias("dataset"),
        F.bool_or(F.coalesce(F.array_contains("tools", R.TRAIN_TOOL),
                             F.lit(False))).alias("has_ml_results"),
        F.max_by("agent", "turn_id").alias("last_agent"))


def ml_results(turns: DataFrame) -> DataFrame:
    """(conv_id, ml_result): per conversation the output of its last turn that
    trained models, as the memory keeps it; conversations without one have no
    row, and an empty output stores nothing."""
    trained = turns.filter(F.array_contains("tools", R.TRAIN_TOOL) & (F.col("output") != ""))
    return trained.groupBy("conv_id").agg(F.max_by("output", "turn_id").alias("ml_result"))


def last_output(turns: DataFrame, ml_results: DataFrame | None = None) -> DataFrame:
    """QL11: per conversation the latest output and agent; the explanation
    context falls back to a fixed text when the output is empty.
    ``ml_results`` (conv_id, ml_result) adds the last model's result, NULL for none."""
    g = turns.groupBy("conv_id").agg(
        F.max("turn_id").alias("last_turn"),
        F.max_by("output", "turn_id").alias("last_output"),
        F.max_by("agent", "turn_id").alias("last_agent"))
    if ml_results is not None:
        g = g.join(ml_results.select("conv_id", F.col("ml_result").alias("last_ml_result")), "conv_id", "left")
    return g.withColumn("explanation_context",
                        F.when(F.coalesce(F.col("last_output"), F.lit("")) == "",
                               R.NO_PREVIOUS_OUTPUT).otherwise(F.col("last_output")))


def explain_text(output: Column) -> Column:
    """QL12 on one output text (the whole text is examined)."""
    low = F.lower(output)
    S = R.EXPLAIN_SENTENCES

    def arr(key):
        return F.array(*[F.lit(s) for s in S[key]])

    empty = F.array().cast("array<string>")
    picked = F.flatten(F.array(
        F.when(output.contains("Accuracy") | output.contains("accuracy"), arr("accuracy")).otherwise(empty),
        F.when(output.contains("RMSE") | output.contains("R²"), arr("regression")).otherwise(empty),
        F.when(low.contains("correlat"), arr("correlation")).otherwise(empty),
        F.when(low.contains("missing"), arr("missing")).otherwise(empty),
        F.when(low.contains("feature") & low.contains("import"), arr("importance")).otherwise(empty)))
    lines = F.when(F.size(picked) == 0, arr("default")).otherwise(picked)
    return F.concat(F.lit(R.EXPLAIN_INTRO), F.lit("\n"), F.array_join(lines, "\n"))


def explain_rules(turns: DataFrame, explain_turns_only: bool = False) -> DataFrame:
    """QL12: the rule-based explanation of the previous output (or the
    no-previous-result text) -- for every turn, i.e. what an explain request
    at that point yields, or only for the explain turns."""
    ex = turns.filter(F.col("intent") == "explain") if explain_turns_only else turns
    text = F.when(F.col("has_previous"), explain_text(F.col("prev_output"))).otherwise(
        R.NO_PREVIOUS_RESULT)
    return ex.select("conv_id", "turn_id", text.alias("explanation"))


def _pct1(x: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(x * 100.0, 1))


def insight_text(task: Column, model: Column, metric: Column, features: Column,
                 last_out: Column) -> Column:
    """QL13 on one (optional) model result; ``task`` NULL = no model yet."""
    def chain(bands, build):
        expr = None
        for bound, verdict, rec in bands:
            val = build(verdict, rec)
            if bound is None:
                return expr.otherwise(val)
            cond = metric >= F.lit(bound)
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)

    cls = chain(R.INSIGHT_CLASSIFICATION, lambda v, r: F.concat(
        F.lit("Accuracy: "), _pct1(metric), F.lit(" — " + v + "\n" + r)))
    reg = None
    for bound, verdict, rec in R.INSIGHT_REGRESSION:
        head, sep, tail = verdict.partition("{pct}")
        v = F.concat(F.lit(head), _pct1(metric), F.lit(tail)) if sep else F.lit(verdict)
        val = F.concat(F.lit("R²: "), F.format_string("%.3f", F.bround(metric, 3)),
                       F.lit(" — "), v, F.lit("\n" + rec))
        if bound is None:
            reg = reg.otherwise(val)
            break
        cond = metric >= F.lit(bound)
        reg = F.when(cond, val) if reg is None else reg.when(cond, val)
    drivers = F.when(F.size(F.coalesce(features, F.array().cast("array<string>"))) > 0,
                     F.concat(F.lit("\n\nKey business drivers: "),
                              F.array_join(F.slice(features, 1, 3), ", "),
                              F.lit("\n" + R.INSIGHT_DRIVERS))).otherwise("")
    with_model = F.concat(F.lit(R.INSIGHT_TITLE + "\nRecommended model: "), model,
                          F.when(task == "classification", F.concat(F.lit("\n"), cls))
                           .when(task == "regression", F.concat(F.lit("\n"), reg)).otherwise(""),
                          drivers)
    no_model = F.concat(F.lit(R.INSIGHT_TITLE + "\n" + "\n".join(R.INSIGHT_NO_MODEL)),
                        F.when(F.lower(F.coalesce(last_out, F.lit(""))).contains("missing"),
                               F.lit("\n" + R.INSIGHT_MISSING_NOTE)).otherwise(""))
    return F.when(task.isNull(), no_model).otherwise(with_model)


def insight_rules(turns: DataFrame, results: DataFrame | None = None,
                  insight_turns_only: bool = False) -> DataFrame:
    """QL13: advice from the conversation's model result (``results``:
    conv_id, task, best_model, best_metric, top_features) or, without one,
    the no-model text -- for every turn or only the business_insight turns."""
    ins = (turns.filter(F.col("intent") == "business_insight") if insight_turns_only
           else turns)
    if results is not None:
        ins = ins.join(results, "conv_id", "left")
    else:
        ins = (ins.withColumn("task", F.lit(None).cast("string"))
                  .withColumn("best_model", F.lit(None).cast("string"))
                  .withColumn("best_metric", F.lit(None).cast("double"))
                  .withColumn("top_features", F.lit(None).cast("array<string>")))
    text = insight_text(F.col("task"), F.col("best_model"), F.col("best_metric"),
                        F.col("top_features"), F.col("prev_output"))
    return ins.select("conv_id", "turn_id", text.alias("insight"))


def response_label(turns: DataFrame) -> DataFrame:
    """QL14: the label shown above each answer and the offline note."""
    agent = F.col("agent")
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in R.RESPONSE_LABELS.items()
                                                   for x in kv]), agent),
                       F.initcap(F.regexp_replace(agent, "_", " ")))
    note = F.when(F.col("used_fallback") & (F.col("intent") == "run_tool"),
                  F.lit(R.OFFLINE_NOTE)).otherwise("")
    return turns.select("conv_id", "turn_id", label.alias("label"),
                        F.concat(F.lit("**["), label, F.lit("]**\n\n"), F.col("output"), note)
                         .alias("response"))


def routing_diagnostics(turns: DataFrame) -> DataFrame:
    """QL15: turns per (agent, routing method)."""
    return turns.groupBy("agent", "method").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
