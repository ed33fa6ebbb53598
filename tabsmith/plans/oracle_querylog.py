"""DuckDB oracle SQL for the query-log queries. The keyword tables are data
(``functions.rules``); here they are written out as SQL CASE / contains
expressions over the conversations view."""

from __future__ import annotations

from tabsmith.functions import rules as R
from tabsmith.plans.querylog_queries import LINEITEM_SCHEMA_TEXT
from tabsmith.plans.sql_fixtures import QUERY_LOG, lit

NL = "chr(10)"
Q = "lower(coalesce(query, ''))"


def _any(text, kws):
    return "(" + " OR ".join(f"contains({text}, {lit(k)})" for k in kws) + ")"


def _hits(text, kws):
    return "(" + " + ".join(f"contains({text}, {lit(k)})::INT" for k in kws) + ")"


def _intent(q=Q):
    return (f"CASE WHEN {_any(q, R.EXPLAIN_KEYWORDS)} THEN 'explain' "
            f"WHEN {_any(q, R.INSIGHT_KEYWORDS)} THEN 'business_insight' ELSE 'run_tool' END")


def _score_cols(q=Q):
    return ", ".join(f"{_hits(q, kws)}::BIGINT AS score_{a.replace('_agent', '')}"
                     for a, kws in R.AGENT_KEYWORDS.items())


def _argmax(prefix=""):
    names = [f"{prefix}score_{a.replace('_agent', '')}" for a in R.AGENT_KEYWORDS]
    g = f"greatest({', '.join(names)})"
    whens = " ".join(f"WHEN {n} = {g} THEN {lit(a)}" for n, a in zip(names, R.AGENT_KEYWORDS))
    return f"CASE WHEN {g} = 0 THEN {lit(R.DEFAULT_AGENT)} {whens} END"


def _routed_cte(src="qlog", has_previous=None):
    """scores -> intent -> agent -> fallback flag."""
    explain = (f"CASE WHEN {has_previous} THEN 'explain_memory' ELSE 'memory' END"
               if has_previous else "'explain_memory'")
    return f"""sc AS (SELECT *, {_intent()} AS intent, contains({Q}, 'outlier') AS is_outlier,
                     {_score_cols()} FROM {src}),
routed AS (SELECT *, CASE WHEN intent = 'explain' THEN {explain}
                          WHEN intent = 'business_insight' THEN 'business_insight'
                          WHEN is_outlier THEN {lit(R.OUTLIER_AGENT)} ELSE {_argmax()} END AS agent
           FROM sc),
routed2 AS (SELECT *, (NOT (intent = 'run_tool' AND is_outlier)) AND agent <> 'memory' AS used_fallback
            FROM routed)"""


def _tools_sql(agent):
    owned = R.AGENT_TOOLS[agent]
    parts = []
    for kw, tools in R.FALLBACK_TOOL_MAP:
        mine = [t for t in tools if t in owned]
        if mine:
            arr = "[" + ", ".join(lit(t) for t in mine) + "]"
            parts.append(f"CASE WHEN contains({Q}, {lit(kw)}) THEN {arr} ELSE []::VARCHAR[] END")
    raw = f"list_concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
    dedup = f"list_filter({raw}, lambda x, i: list_position({raw}, x) = i)"
    return f"CASE WHEN len({dedup}) = 0 THEN [{lit(owned[0])}] ELSE {dedup} END"


def _per_agent(build):
    return "CASE " + " ".join(f"WHEN agent = {lit(a)} THEN {build(a)}" for a in R.AGENT_TOOLS) + " END"


def _rule_sql(agent):
    owned = R.AGENT_TOOLS[agent]
    picks = [f"CASE WHEN contains({Q}, {lit(kw)}) THEN {lit(t)} END"
             for kw, t in R.RULE_TOOL_MAP if t in owned]
    tool = f"coalesce({', '.join(picks)})" if picks else "NULL::VARCHAR"
    return f"(CASE WHEN {_any(Q, R.RULE_VETO)} THEN NULL ELSE {tool} END)"


def classify_intent():
    return f"WITH {QUERY_LOG}\nSELECT conv_id, turn, {_intent()} AS intent FROM qlog"


def agent_scores():
    return (f"WITH {QUERY_LOG},\ns AS (SELECT conv_id, turn, {_score_cols()} FROM qlog)\n"
            f"SELECT *, {_argmax()} AS agent FROM s")


def schema_term_override():
    text = lit(LINEITEM_SCHEMA_TEXT.lower())
    split = f"list_filter(regexp_split_to_array({Q}, {lit(R.WHITESPACE_RUN)}), lambda t: t <> '')"
    return (f"WITH {QUERY_LOG}\nSELECT conv_id, turn, "
            f"coalesce(len(list_filter({split}, lambda t: contains({text}, t))) > 0, false) "
            f"AS schema_override FROM qlog")


def outlier_override():
    hit = f"contains({Q}, 'outlier')"
    return (f"WITH {QUERY_LOG}\nSELECT conv_id, turn, {hit} AS outlier_override, "
            f"CASE WHEN {hit} THEN {lit(R.OUTLIER_AGENT)} END AS override_agent, "
            f"CASE WHEN {hit} THEN {lit(R.OUTLIER_TOOL)} END AS override_tool FROM qlog")


def fallback_tools():
    return (f"WITH {QUERY_LOG},\n{_routed_cte()}\n"
            f"SELECT conv_id, turn, agent, array_to_string({_per_agent(_tools_sql)}, ',') AS tools "
            f"FROM routed2")


def rule_tool():
    return (f"WITH {QUERY_LOG},\n{_routed_cte()}\n"
            f"SELECT conv_id, turn, agent, {_per_agent(_rule_sql)} AS rule_tool FROM routed2")


def final_tool():
    first = _per_agent(lambda a: lit(R.AGENT_TOOLS[a][0]))
    return (f"WITH {QUERY_LOG},\n{_routed_cte()}\n"
            f"SELECT conv_id, turn, agent, coalesce({_per_agent(_rule_sql)}, {first}) AS final_tool "
            f"FROM routed2")


def _turns_cte():
    run = "intent = 'run_tool'"
    return f"""t0 AS (
  SELECT u.conv_id, u.turn, u.text AS query, coalesce(a.text, '') AS output
  FROM (SELECT * FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
    ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn),
t1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_id FROM t0),
t2 AS (SELECT t.*, p.output AS prev_output, coalesce(p.output <> '', false) AS has_previous
       FROM t1 t LEFT JOIN t1 p ON p.conv_id = t.conv_id AND p.turn_id + 1 = t.turn_id),
{_routed_cte("t2", "has_previous")},
turns AS (SELECT *, CASE WHEN {run} AND is_outlier THEN [{lit(R.OUTLIER_TOOL)}]
                         WHEN {run} THEN {_per_agent(_tools_sql)} END AS tools,
                 agent = 'visualization_agent' AS figure_generated,
                 CASE WHEN used_fallback THEN {lit(R.ROUTING_METHODS[1])}
                      ELSE {lit(R.ROUTING_METHODS[0])} END AS method
          FROM routed2)"""


RECORDS = ("records AS (SELECT conv_id, turn_id, NULL::VARCHAR AS timestamp, query AS user_query, "
           "agent AS agent_used, output AS tool_output, figure_generated, "
           "'conversations' AS dataset_name, (SELECT count(*) FROM conversations)::BIGINT AS dataset_rows, "
           "4::BIGINT AS dataset_cols, used_fallback FROM turns)")


ML_RESULTS = (f"mlres AS (SELECT conv_id, arg_max(output, turn_id) AS ml_result FROM turns "
              f"WHERE list_contains(tools, {lit(R.TRAIN_TOOL)}) AND output <> '' GROUP BY conv_id)")


def append_turn():
    return f"WITH {_turns_cte()},\n{RECORDS}\nSELECT * FROM records"


def recent_context(n=6, snippet=300):
    out = "tool_output"
    preview = (f"CASE WHEN figure_generated THEN '[chart/figure generated]' ELSE "
               f"replace(substring({out}, 1, {snippet}), {NL}, ' ') || "
               f"CASE WHEN length({out}) > {snippet} THEN '...' ELSE '' END END")
    block = (f"{NL} || '[Turn ' || turn_id || ' | ' || coalesce(timestamp, 'None') || ']' || {NL} || "
             f"'  User asked : ' || user_query || {NL} || '  Agent used : ' || agent_used || {NL} || "
             f"'  Output     : ' || {preview} || {NL} || '  Dataset    : ' || dataset_name || "
             f"' (' || dataset_rows || ', ' || dataset_cols || ')'")
    return f"""WITH {_turns_cte()},
{RECORDS},
{ML_RESULTS},
rec AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total FROM records),
blocks AS (SELECT conv_id, turn_id, total, {block} AS b FROM rec WHERE turn_id > total - {n})
SELECT conv_id, 'Session so far (' || max(total) || ' total turns):' || {NL} ||
       string_agg(b, {NL} ORDER BY turn_id) ||
       coalesce({NL} || {NL} || 'Last ML result: ' || max(ml_result), '') AS context
FROM blocks LEFT JOIN mlres USING (conv_id) GROUP BY conv_id"""


def session_summary():
    return (f"WITH {_turns_cte()}\nSELECT conv_id, count(*)::BIGINT AS total_turns, "
            f"string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents_used, 'conversations' AS dataset, "
            f"bool_or(coalesce(list_contains(tools, 'auto_train_models'), false)) AS has_ml_results, "
            f"arg_max(agent, turn_id) AS last_agent FROM turns GROUP BY conv_id")


def last_output():
    return (f"WITH {_turns_cte()},\n{ML_RESULTS},\ng AS (SELECT conv_id, max(turn_id) AS last_turn, "
            f"arg_max(output, turn_id) AS last_output, arg_max(agent, turn_id) AS last_agent "
            f"FROM turns GROUP BY conv_id)\nSELECT g.*, ml_result AS last_ml_result, CASE WHEN coalesce(last_output, '') = '' "
            f"THEN {lit(R.NO_PREVIOUS_OUTPUT)} ELSE last_output END AS explanation_context "
            f"FROM g LEFT JOIN mlres USING (conv_id)")


def _explain_sql(o):
    S = R.EXPLAIN_SENTENCES

    def arr(k):
        return "[" + ", ".join(lit(s) for s in S[k]) + "]"
    low = f"lower({o})"
    parts = [
        (f"(contains({o}, 'Accuracy') OR contains({o}, 'accuracy'))", "accuracy"),
        (f"(contains({o}, 'RMSE') OR contains({o}, 'R²'))", "regression"),
        (f"contains({low}, 'correlat')", "correlation"),
        (f"contains({low}, 'missing')", "missing"),
        (f"(contains({low}, 'feature') AND contains({low}, 'import'))", "importance"),
    ]
    picked = "list_concat(" + ", ".join(f"CASE WHEN {c} THEN {arr(k)} ELSE []::VARCHAR[] END"
                                        for c, k in parts) + ")"
    lines = f"CASE WHEN len({picked}) = 0 THEN {arr('default')} ELSE {picked} END"
    return f"{lit(R.EXPLAIN_INTRO)} || {NL} || array_to_string({lines}, {NL})"


def explain_rules():
    return (f"WITH {_turns_cte()}\nSELECT conv_id, turn_id, CASE WHEN has_previous THEN "
            f"{_explain_sql('prev_output')} ELSE {lit(R.NO_PREVIOUS_RESULT)} END AS explanation "
            f"FROM turns")


def insight_rules():
    no_model = lit(R.INSIGHT_TITLE + "\n" + "\n".join(R.INSIGHT_NO_MODEL))
    note = (f"CASE WHEN contains(lower(coalesce(prev_output, '')), 'missing') THEN "
            f"{lit(chr(10) + R.INSIGHT_MISSING_NOTE)} ELSE '' END")
    return (f"WITH {_turns_cte()}\nSELECT conv_id, turn_id, {no_model} || {note} AS insight "
            f"FROM turns")


def _initcap_words(s):
    return (f"array_to_string(list_transform(string_split({s}, ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def response_label():
    labels = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in R.RESPONSE_LABELS.items())
    words = _initcap_words("replace(agent, '_', ' ')")
    label = f"CASE agent {labels} ELSE {words} END"
    note = (f"CASE WHEN used_fallback AND intent = 'run_tool' THEN {lit(R.OFFLINE_NOTE)} "
            f"ELSE '' END")
    return (f"WITH {_turns_cte()},\nl AS (SELECT *, {label} AS label FROM turns)\n"
            f"SELECT conv_id, turn_id, label, '**[' || label || ']**' || {NL} || {NL} || output "
            f"|| {note} AS response FROM l")


def routing_diagnostics():
    return (f"WITH {_turns_cte()}\nSELECT agent, method, count(*)::BIGINT AS n FROM turns "
            f"GROUP BY agent, method")


def _stream_routed():
    return (f"{QUERY_LOG},\n{_routed_cte()},\n"
            f"r AS (SELECT *, CASE WHEN used_fallback THEN {lit(R.ROUTING_METHODS[1])} "
            f"ELSE {lit(R.ROUTING_METHODS[0])} END AS method FROM routed2)")


def stream_routing_diagnostics():
    return (f"WITH {_stream_routed()}\nSELECT agent, method, count(*)::BIGINT AS n FROM r "
            f"GROUP BY agent, method")


def querylog_sql() -> dict[str, str]:
    return {
        "classify_intent": classify_intent(),
        "agent_scores": agent_scores(),
        "schema_term_override": schema_term_override(),
        "outlier_override": outlier_override(),
        "fallback_tools": fallback_tools(),
        "rule_tool": rule_tool(),
        "final_tool": final_tool(),
        "append_turn": append_turn(),
        "recent_context": recent_context(),
        "session_summary": session_summary(),
        "last_output": last_output(),
        "explain_rules": explain_rules(),
        "insight_rules": insight_rules(),
        "response_label": response_label(),
        "routing_diagnostics": routing_diagnostics(),
        "stream_routing_diagnostics": stream_routing_diagnostics(),
        "stream_session_summary": session_summary(),
        "stream_recent_context": recent_context(),
        "stream_last_output": last_output(),
    }
