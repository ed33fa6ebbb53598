"""Routing rules on the F5 query log (FIXTURES.md), plus session memory."""

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import querylog as ql

# FIXTURES F5: (id, query, intent, scores a/v/c/m, agent without QL3/QL4)
F5 = [
    (1, "Show me the data quality report", "run_tool", (0, 1, 2, 0), "cleaning_agent"),
    (2, "Fill missing values with the column mean", "run_tool", (1, 0, 3, 0), "cleaning_agent"),
    (3, "Show me a correlation heatmap", "run_tool", (0, 3, 0, 0), "visualization_agent"),
    (4, "Explain what that correlation means", "explain", (0, 1, 0, 0), "visualization_agent"),
    (5, "Train ML models", "run_tool", (0, 0, 0, 3), "ml_agent"),
    (6, "What should I do to improve the business?", "business_insight", (0, 0, 0, 0),
     "analysis_agent"),
    (7, "Summarize the dataset", "run_tool", (1, 0, 0, 0), "analysis_agent"),
    (8, "Show feature distributions", "run_tool", (0, 2, 0, 0), "visualization_agent"),
    (9, "Remove duplicate rows", "run_tool", (1, 0, 2, 0), "cleaning_agent"),
    (10, "Which ML task is this suited for?", "run_tool", (0, 0, 0, 2), "ml_agent"),
    (11, "Train models and show accuracy", "run_tool", (0, 1, 0, 3), "ml_agent"),
    (12, "Which model should I deploy?", "business_insight", (0, 0, 0, 1), "ml_agent"),
    (13, "give me the data summary", "run_tool", (1, 0, 0, 0), "analysis_agent"),
    (14, "show missing values", "run_tool", (0, 1, 2, 0), "cleaning_agent"),
    (15, "plot price distribution", "run_tool", (0, 2, 0, 0), "visualization_agent"),
    (16, "train a regression model", "run_tool", (0, 0, 0, 3), "ml_agent"),
    (17, "remove outliers please", "run_tool", (0, 0, 0, 0), "analysis_agent"),
    (18, "hello", "run_tool", (0, 0, 0, 0), "analysis_agent"),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(i, q) for i, q, *_ in F5], "id long, query string")


def test_intent_scores_agent(log):
    got = {r["id"]: r for r in ql.agent_scores(ql.classify_intent(log)).collect()}
    for i, _, intent, scores, agent in F5:
        r = got[i]
        assert r["intent"] == intent, i
        assert (r["score_analysis"], r["score_visualization"], r["score_cleaning"],
                r["score_ml"]) == scores, i
        assert r["agent"] == agent, i


def test_outlier_override_and_route(log):
    r = {x["id"]: x for x in ql.route(log).collect()}
    assert r[17]["agent"] == "cleaning_agent" and r[17]["used_fallback"] is False
    assert r[4]["agent"] == "explain_memory"
    assert r[6]["agent"] == "business_insight"
    assert r[18]["agent"] == "analysis_agent" and r[18]["method"] == "Keyword fallback"


def test_schema_override(log):
    text = "\nDATASET DETAILS:\n\nColumns: a, b\n\nTotal Rows: Unknown\n"
    r = {x["id"]: x["schema_override"] for x in ql.schema_term_override(log, text).collect()}
    assert r[18] is False           # "hello" is nowhere in the text
    assert r[13] is True            # "data" occurs in "DATASET"


def test_tools(log):
    r = ql.final_tool(ql.rule_tool(ql.fallback_tools(ql.route(log))))
    got = {x["id"]: x for x in r.collect()}
    assert got[2]["tools"] == ["cleaning_report", "fill_missing_mean"]
    assert got[3]["rule_tool"] == "correlation_heatmap"
    assert got[5]["final_tool"] == "auto_train_models"
    assert got[10]["tools"] == ["auto_train_models", "detect_task_type"] or \
        got[10]["tools"] == ["detect_task_type"]
    assert got[18]["final_tool"] == "dataset_summary"
    assert got[7]["tools"] == ["dataset_summary"]


def test_memory_operators(spark):
    rows = [(1, 0, "Show me the data quality report", "Total missing cells: 9"),
            (1, 2, "Explain what that means", "ok"),
            (1, 4, "What should I do to improve the business?", "x" * 400),
            (2, 0, "hello", None)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, query string, output string")
    turns = ql.conversation_turns(log)
    t = {(r["conv_id"], r["turn_id"]): r for r in turns.collect()}
    assert [t[(1, k)]["turn"] for k in (1, 2, 3)] == [0, 2, 4]
    ex = {r["turn_id"]: r["explanation"] for r in ql.explain_rules(turns, True).collect()}
    assert "Missing values can bias model training" in ex[2]
    ins = ql.insight_rules(turns, insight_turns_only=True).collect()
    assert ins[0]["insight"].startswith("Business Insight Report\n\nNo ML results found yet.")
    recs = ql.append_turn(turns, "demo", 10, 3)
    ctx = {r["conv_id"]: r["context"] for r in ql.recent_context(recs, n=2).collect()}
    assert ctx[1].startswith("Session so far (3 total turns):\n\n[Turn 2 | None]")
    assert "x" * 300 + "..." in ctx[1] and "[Turn 1" not in ctx[1]
    summ = {r["conv_id"]: r for r in ql.session_summary(turns).collect()}
    assert summ[1]["total_turns"] == 3 and summ[1]["last_agent"] == "business_insight"
    last = {r["conv_id"]: r for r in ql.last_output(turns).collect()}
    assert last[2]["explanation_context"] == "No previous output to explain."
    lab = {(r["conv_id"], r["turn_id"]): r["label"] for r in ql.response_label(turns).collect()}
    assert lab[(1, 1)] == "Cleaning Agent" and lab[(1, 3)] == "Business Insight"


def test_insight_with_model(spark):
    res = spark.createDataFrame(
        [(1, "classification", "Random Forest", 0.8234, ["a", "b", "c", "d"])],
        "conv_id long, task string, best_model string, best_metric double, "
        "top_features array<string>")
    rows = [(1, 0, "which model should i deploy", "")]
    turns = ql.conversation_turns(spark.createDataFrame(
        rows, "conv_id long, turn long, query string, output string"))
    text = ql.insight_rules(turns, res).first()["insight"]
    assert "Recommended model: Random Forest" in text
    assert "Accuracy: 82.3% — Good. Acceptable for most business cases." in text
    assert "Key business drivers: a, b, c" in text and F is not None
