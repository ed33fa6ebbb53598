"""Session walkthroughs (PL1-PL3): the sample question sequences, each
question routed by the rule expressions and answered by running the chosen
tools on the current dataset version.

Routing runs as one Spark query over the question list (the QL operators);
the driver then runs the chosen operators in order, since each step may
change the dataset the next one sees. Every part of a tool's result is written
in full, as one JSON object a row, to a table in the shared folder; the
transcript counts that table's rows, so no part is computed twice or pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions import rules as R
from tabsmith.functions.columns import col
from tabsmith.operators import querylog as ql
from tabsmith.plans.registry import TOOLS
from tabsmith.session import scratch_path, shuffles_dropped
from tabsmith.sources.dataset import as_dataset, save_version

# FIXED VALUES: the sample question sequences
FLOW_QUALITY = [
    "Show me the data quality report",
    "Fill missing values with the column mean",
    "Show me a correlation heatmap",
    "Explain what that correlation means",
    "Train ML models",
    "What should I do to improve the business?",
]
FLOW_SUMMARY = [
    "Summarize the dataset",
    "Show feature distributions",
    "Remove duplicate rows",
    "Which ML task is this suited for?",
    "Train models and show accuracy",
    "Which model should I deploy?",
]
QUICK_CHIPS = [
    "give me the data summary",
    "show missing values",
    "plot price distribution",
    "train a regression model",
]

TRANSCRIPT = ("step bigint, query string, intent string, agent string, tools string, "
              "rows_after bigint, cols_after bigint, output string")


def route_questions(spark: SparkSession, questions: list[str]) -> list:
    """Intent, agent and tools of each question (one small Spark query)."""
    log = spark.createDataFrame(list(enumerate(questions, start=1)), "step long, query string")
    routed = ql.fallback_tools(ql.route(log))
    return sorted(routed.select("step", "query", "intent", "agent", "used_fallback", "tools")
                        .collect(), key=lambda r: r["step"])


RESULTS = "step bigint, tool string, part string, result string"


def _keep(path: str, step: int, tool: str, part: str, frame: DataFrame) -> None:
    """One part of a tool's result, appended to the session's results."""
    (frame.select(F.lit(step).cast("bigint").alias("step"), F.lit(tool).alias("tool"), F.lit(part).alias("part"),
                  F.to_json(F.struct(*[col(c) for c in frame.columns]), {"ignoreNullFields": "false"}).alias("result"))
          .write.mode("append").parquet(path))


def run_session(df: DataFrame, questions: list[str], name: str = "dataset") -> DataFrame:
    """The transcript alone: one row a question."""
    return session_tables(df, questions, name)[0]


def session_results(df: DataFrame, questions: list[str], name: str = "dataset") -> DataFrame:
    """The transcript with the results: one row for every row of every tool
    result (``tool``, ``part``, ``result`` as JSON), or one row with nulls there
    for a step that answered in words or changed the dataset only."""
    transcript, results = session_tables(df, questions, name)
    return transcript.drop("results").join(results, "step", "left")


def session_tables(df: DataFrame, questions: list[str], name: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """(transcript, results) of a session: a row a question, and a row for
    every row that its tools returned."""
    with shuffles_dropped(df.sparkSession):
        return _session_tables(df, questions, name)


def _session_tables(df: DataFrame, questions: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    ds = as_dataset(df, name)
    last_output, model_result = "", None
    rows, kept = [], scratch_path(spark, "session-results")
    size = ds.df.count()
    spark.createDataFrame([], RESULTS).write.parquet(kept)      # a session may use no tool
    for r in route_questions(spark, questions):
        intent, agent = r["intent"], r["agent"]
        out_text, tools = "", []
        if intent == "explain":
            text_df = spark.createDataFrame([(last_output,)], "o string")
            out_text = (text_df.select(ql.explain_text(F.col("o"))).first()[0] if last_output
                        else R.NO_PREVIOUS_RESULT)
        elif intent == "business_insight":
            res = model_result
            base = spark.createDataFrame([(last_output,)], "o string")
            if res is not None and res.best is not None:
                feats = [f for f, _ in res.best.importances] or next(
                    ([f for f, _ in s.importances] for s in res.scores if s.importances), [])
                base = base.select("o", F.lit(res.task).alias("task"),
                                   F.lit(res.best.model).alias("m"),
                                   F.lit(res.best.value).alias("v"),
                                   F.array(*[F.lit(f) for f in feats]).cast("array<string>").alias("f"))
            else:
                base = base.select("o", F.lit(None).cast("string").alias("task"),
                                   F.lit(None).cast("string").alias("m"),
                                   F.lit(None).cast("double").alias("v"),
                                   F.lit(None).cast("array<string>").alias("f"))
            out_text = base.select(ql.insight_text(F.col("task"), F.col("m"), F.col("v"),
                                                   F.col("f"), F.col("o"))).first()[0]
        else:
            tools = list(r["tools"] or [])
            if R.OUTLIER_KEYWORD in r["query"].lower():
                tools = [R.OUTLIER_TOOL]
            texts = []
            for t in tools:
                run = TOOLS[t](ds.df, r["query"])
                texts.append(run.summary)
                for part, frame in run.parts().items():
                    _keep(kept, r["step"], t, part, frame)
                if run.dataset is not None:
                    # new version written to the shared folder: later steps
                    # read it back instead of re-running the cleaning lineage
                    ds = save_version(ds, run.dataset)
                    size = ds.df.count()
                if run.model is not None:
                    model_result = run.model
            out_text = "\n\n".join(texts)
        last_output = out_text
        rows.append((r["step"], r["query"], intent, agent, ",".join(tools),
                     size, len(ds.df.columns), out_text))
    results = spark.read.schema(RESULTS).parquet(kept)
    counts = (results.groupBy("step", "tool", "part").agg(F.count(F.lit(1)).alias("rows")).groupBy("step")
              .agg(F.array_sort(F.collect_list(F.struct("tool", "part", "rows"))).alias("results")))
    steps = spark.createDataFrame(rows, TRANSCRIPT).join(counts, "step", "left")
    none = F.array().cast("array<struct<tool: string, part: string, rows: bigint>>")
    return steps.withColumn("results", F.coalesce("results", none)), results


def session_queries() -> dict:
    from tabsmith.sources import fixtures as fx

    def make(questions):
        def q(spark, sf):
            return session_results(fx.dirty_lineitem(spark, sf), questions, "dirty_lineitem")
        return q
    return {"session_quality_to_advice": make(FLOW_QUALITY),
            "session_summary_to_deploy": make(FLOW_SUMMARY),
            "session_quick_chips": make(QUICK_CHIPS)}
