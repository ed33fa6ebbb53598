"""Keyword rules of the chat router, as data, plus their compilation into
Spark column expressions (no UDF: ``contains`` over a lower-cased column).

Every table below is a FIXED VALUE that must equal the routing behaviour
being reproduced: keywords, their order (order decides ties and which tool
comes first) and the sentences emitted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (routing rules; order matters)
# ---------------------------------------------------------------------------

EXPLAIN_KEYWORDS = [
    "explain", "what does this mean", "interpret", "tell me more",
    "elaborate", "describe this", "what is this", "clarify",
    "what does that mean", "meaning of", "what do you mean",
    "break it down", "in simple terms", "why is", "how does this work",
]

INSIGHT_KEYWORDS = [
    "business insight", "business decision", "what should i do",
    "recommend", "recommendation", "advice", "suggest", "action",
    "improve", "next step", "decision", "deploy", "production ready",
    "should i use", "which model should", "is this good", "good enough",
    "what does accuracy mean", "interpret result", "business impact",
]

AGENT_KEYWORDS = {
    "analysis_agent": [
        "summary", "summarize", "describe", "statistics", "statistic",
        "overview", "explore", "column", "shape", "rows", "dtype",
        "tell me about", "what is in", "top correlat",
    ],
    "visualization_agent": [
        "heatmap", "heat map", "plot", "chart", "graph", "visual",
        "distribution", "histogram", "hist", "boxplot", "box plot",
        "pairplot", "pair plot", "scatter", "violin", "draw",
        "figure", "show", "correlat",
    ],
    "cleaning_agent": [
        "clean", "cleaning", "duplicate", "missing value", "null value",
        "nan", "fill missing", "fill null", "drop missing", "drop null",
        "remove duplicate", "impute", "quality", "fix data",
        "handle missing", "data quality", "missing", "replace null",
        "replace missing", "fill with mean", "fill with median",
    ],
    "ml_agent": [
        "train", "model", "predict", "machine learning", " ml ",
        "automl", "classif", "regress", "accuracy", "metric",
        "feature importance", "random forest", "logistic", "linear model",
        "performance", "evaluate", "task type", "suited for",
    ],
}
DEFAULT_AGENT = "analysis_agent"

AGENT_TOOLS = {
    "analysis_agent": ["dataset_summary", "describe_statistics", "correlation_summary"],
    "visualization_agent": ["correlation_heatmap", "feature_distributions",
                            "pairplot_visualization", "boxplot_visualization",
                            "scatter_plot", "histogram_plot", "violin_plot"],
    "cleaning_agent": ["cleaning_report", "remove_duplicates", "fill_missing_mean",
                       "fill_missing_median", "fill_missing_mode", "drop_missing_rows"],
    "ml_agent": ["detect_task_type", "auto_train_models"],
}

# offline executor: every matching keyword adds its tools, in this order
FALLBACK_TOOL_MAP = [
    ("summary", ["dataset_summary"]),
    ("statistic", ["describe_statistics"]),
    ("describe", ["describe_statistics"]),
    ("correlat", ["correlation_heatmap"]),
    ("heatmap", ["correlation_heatmap"]),
    ("histogram", ["histogram_plot"]),
    ("hist", ["histogram_plot"]),
    ("scatter", ["scatter_plot"]),
    ("violin", ["violin_plot"]),
    ("distribut", ["feature_distributions"]),
    ("boxplot", ["boxplot_visualization"]),
    ("box plot", ["boxplot_visualization"]),
    ("pairplot", ["pairplot_visualization"]),
    ("pair plot", ["pairplot_visualization"]),
    ("missing", ["cleaning_report", "fill_missing_mean"]),
    ("null", ["fill_missing_mean"]),
    ("fill", ["fill_missing_mean"]),
    ("median", ["fill_missing_median"]),
    ("mode", ["fill_missing_mode"]),
    ("duplicate", ["remove_duplicates"]),
    ("clean", ["cleaning_report"]),
    ("quality", ["cleaning_report"]),
    ("train", ["auto_train_models"]),
    ("model", ["auto_train_models"]),
    ("automl", ["auto_train_models"]),
    ("classif", ["auto_train_models"]),
    ("regress", ["auto_train_models"]),
    ("task", ["detect_task_type"]),
]

# online agent: the first keyword (in this order) whose tool the agent owns
RULE_TOOL_MAP = [
    ("histogram", "histogram_plot"),
    ("hist", "histogram_plot"),
    ("scatter", "scatter_plot"),
    ("violin", "violin_plot"),
    ("boxplot", "boxplot_visualization"),
    ("box plot", "boxplot_visualization"),
    ("heatmap", "correlation_heatmap"),
    ("correlat", "correlation_heatmap"),
    ("pairplot", "pairplot_visualization"),
    ("pair plot", "pairplot_visualization"),
    ("distribut", "feature_distributions"),
    ("missing", "fill_missing_mean"),
    ("null", "fill_missing_mean"),
    ("fill mean", "fill_missing_mean"),
    ("fill median", "fill_missing_median"),
    ("fill mode", "fill_missing_mode"),
    ("duplicate", "remove_duplicates"),
    ("summary", "dataset_summary"),
    ("statistic", "describe_statistics"),
    ("describe", "describe_statistics"),
    ("train", "auto_train_models"),
    ("model", "auto_train_models"),
    ("classif", "auto_train_models"),
    ("regress", "auto_train_models"),
    ("task", "detect_task_type"),
]
RULE_VETO = ["explain", "interpret", "meaning", "what does"]

OUTLIER_KEYWORD = "outlier"
OUTLIER_AGENT, OUTLIER_TOOL = "cleaning_agent", "remove_outliers"
TRAIN_TOOL = "auto_train_models"

# rule-based explanation of the previous output: (test, sentences)
EXPLAIN_INTRO = "Here is an interpretation of the previous output:\n"
EXPLAIN_SENTENCES = {
    "accuracy": [
        "The model accuracy tells you what percentage of predictions were correct.",
        "Higher is better — above 0.85 is generally considered good for most applications.",
    ],
    "regression": [
        "RMSE (Root Mean Squared Error) shows average prediction error — lower is better.",
        "R² shows how much of the variation is explained — closer to 1.0 is better.",
    ],
    "correlation": [
        "Correlation values range from -1 to +1.",
        "Values close to +1 mean two features increase together.",
        "Values close to -1 mean one increases as the other decreases.",
        "Values near 0 mean the features are not related.",
    ],
    "missing": ["Missing values can bias model training and should be filled or dropped."],
    "importance": [
        "Feature importance shows which columns most influence the prediction.",
        "Higher importance = more impact on the model's decisions.",
    ],
    "default": [
        "The previous analysis completed successfully.",
        "Ask a more specific question like 'what does the accuracy mean?' for a targeted explanation.",
    ],
}

# rule-based business advice
INSIGHT_TITLE = "Business Insight Report\n"
INSIGHT_CLASSIFICATION = [   # (lower bound, verdict, recommendation)
    (0.95, "Excellent. This model is production-ready.",
     "Recommendation: Deploy with confidence. Monitor for data drift monthly."),
    (0.80, "Good. Acceptable for most business cases.",
     "Recommendation: Deploy with human oversight. Review edge cases."),
    (0.65, "Fair. Needs improvement before production.",
     "Recommendation: Collect more labeled data. Try feature engineering."),
    (None, "Poor. Not suitable for production.",
     "Recommendation: Review data quality. Consider different features."),
]
INSIGHT_REGRESSION = [       # (lower bound, verdict, recommendation); {pct} = R² as %
    (0.85, "Strong predictor. Model explains {pct} of variance.",
     "Recommendation: Ready for business forecasting use."),
    (0.60, "Moderate predictor.",
     "Recommendation: Useful directionally, but add more features."),
    (None, "Weak predictor.",
     "Recommendation: Reconsider features. The chosen columns may not predict the target well."),
]
INSIGHT_DRIVERS = "Focus business decisions on these factors for maximum impact."
INSIGHT_NO_MODEL = [
    "No ML results found yet. Please train models first.",
    "Ask: 'Train ML models' to get model performance metrics.",
]
INSIGHT_MISSING_NOTE = "\nNote: Missing values were detected. Clean data before training for best results."
NO_PREVIOUS_RESULT = "No previous result found. Please run something first."
NO_PREVIOUS_OUTPUT = "No previous output to explain."
OFFLINE_NOTE = "\n\n> *Model server offline — keyword routing used.*"

RESPONSE_LABELS = {"explain_memory": "Context Explanation", "business_insight": "Business Insight"}
ROUTING_METHODS = ("LLM", "Keyword fallback")

# interpretation bands: (lower bound, label), checked top down
ACCURACY_BANDS = [(0.95, "Excellent"), (0.80, "Good"), (0.65, "Fair"), (None, "Poor")]
R2_BANDS = [(0.85, "Strong"), (0.60, "Moderate"), (None, "Weak")]

# characters Python's str.split() treats as whitespace (derived, not listed)
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
WHITESPACE_RUN = "[" + PY_WHITESPACE + "]+"


# ---------------------------------------------------------------------------
# compilation to column expressions
# ---------------------------------------------------------------------------

def any_contains(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(k) for k in keywords])


def hit_count(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(k).cast("int") for k in keywords])


def intent_expr(q: Column) -> Column:
    """QL1 on a lower-cased query."""
    return (F.when(any_contains(q, EXPLAIN_KEYWORDS), "explain")
             .when(any_contains(q, INSIGHT_KEYWORDS), "business_insight")
             .otherwise("run_tool"))


def argmax_agent(scores: dict[str, Column]) -> Column:
    """First agent (in table order) with the highest score; all zero ->
    the default agent."""
    best = F.greatest(*scores.values())
    pick = None
    for agent, s in scores.items():
        pick = F.when(s == best, agent) if pick is None else pick.when(s == best, agent)
    return F.when(best == 0, DEFAULT_AGENT).otherwise(pick.otherwise(DEFAULT_AGENT))


def fallback_tools_expr(q: Column, agent: str) -> Column:
    """QL5 for one agent: tools of every matching keyword in map order,
    without repeats; none -> the agent's first tool."""
    owned = AGENT_TOOLS[agent]
    parts = []
    for kw, tools in FALLBACK_TOOL_MAP:
        mine = [t for t in tools if t in owned]
        if mine:
            parts.append(F.when(q.contains(kw), F.array(*[F.lit(t) for t in mine]))
                          .otherwise(F.array().cast("array<string>")))
    arr = F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")
    return F.when(F.size(arr) == 0, F.array(F.lit(owned[0]))).otherwise(arr)


def rule_tool_expr(q: Column, agent: str) -> Column:
    """QL6 for one agent: the first keyword whose tool the agent owns; a
    query asking for an explanation gets none."""
    owned = AGENT_TOOLS[agent]
    picks = [F.when(q.contains(kw), F.lit(t)) for kw, t in RULE_TOOL_MAP if t in owned]
    tool = F.coalesce(*picks) if picks else F.lit(None).cast("string")
    return F.when(any_contains(q, RULE_VETO), F.lit(None).cast("string")).otherwise(tool)


def per_agent(agent: Column, build) -> Column:
    """Evaluate ``build(name)`` for the agent named in the ``agent`` column."""
    expr = None
    for name in AGENT_TOOLS:
        expr = F.when(agent == name, build(name)) if expr is None else expr.when(agent == name, build(name))
    return expr


def band_expr(metric: Column, bands: list) -> Column:
    expr = None
    for bound, label in bands:
        if bound is None:
            return expr.otherwise(label) if expr is not None else F.lit(label)
        cond = metric >= F.lit(bound)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr
