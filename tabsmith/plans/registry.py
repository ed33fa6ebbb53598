"""Tool registry: tool name -> operator over a DataFrame.

Each entry returns (result frame, new dataset or None, summary text). The
summary is the short text the session memory keeps for later explain /
advice turns; it names what was computed, never data rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabsmith.functions.columns import CATEGORICAL, NUMERIC, col, columns_info
from tabsmith.operators import automl, charts, clean, profile


@dataclass
class ToolRun:
    frame: DataFrame | None
    dataset: DataFrame | None
    summary: str
    model: object | None = None
    more: dict[str, DataFrame] = field(default_factory=dict)    # further parts of the result

    def parts(self) -> dict[str, DataFrame]:
        return ({} if self.frame is None else {"result": self.frame}) | self.more


def _report(frame: DataFrame, title: str, **more: DataFrame) -> ToolRun:
    return ToolRun(frame, None, title, more=more)


def _cleaning(op: Callable, verb: str):
    def run(df: DataFrame, query: str) -> ToolRun:
        out = op(df)
        before, after = df.count(), out.count()
        return ToolRun(None, out, f"{verb}: {before - after} rows removed, {after} rows remain.")
    return run


def _missing(df: DataFrame, columns: list[str]) -> int:
    return sum(v for k, v in profile.missing_counts(df.select(*[col(c) for c in columns])).items()) if columns else 0


def _fill(op: Callable, what: str, cls: str):
    def run(df: DataFrame, query: str) -> ToolRun:
        out = op(df)
        names = [c.name for c in columns_info(df) if c.cls == cls]
        filled = _missing(df, names) - _missing(out, names)
        return ToolRun(None, out, f"Filled {filled} missing values ({what}).")
    return run


def _auto_train(df: DataFrame, query: str) -> ToolRun:
    from pyspark.sql import functions as F
    q = df.sparkSession.createDataFrame([(query,)], "q string")
    target = q.select(automl.resolve_target_expr(F.col("q"), df.columns).alias("t")).first()["t"]
    res = automl.auto_train(df, target)
    board = automl.leaderboard(res)
    metric = "Accuracy" if res.task == automl.CLASSIFICATION else "R²"
    best = f"{res.best.model} ({metric}: {res.best.value:.4f})" if res.best else "none"
    return ToolRun(board, None, f"AutoML Results: task {res.task}, target {res.target}, "
                                f"best model {best}; feature importance computed.", res,
                   {"importance": automl.importance_frame(res), "model": automl.model_result(res)})


def _task(df: DataFrame, query: str) -> ToolRun:
    return _report(automl.detect_task_type(df, df.columns[-1]), "Task detection done.")


TOOLS: dict[str, Callable[[DataFrame, str], ToolRun]] = {
    "dataset_summary": lambda df, q: _report(profile.dataset_summary(df),
                                             "Dataset summary with missing values per column."),
    "describe_statistics": lambda df, q: _report(profile.describe_statistics(df),
                                                 "Descriptive statistics and most frequent values.",
                                                 top_values=profile.top_values(df)),
    "correlation_summary": lambda df, q: _report(profile.correlation_pairs(df),
                                                 "Top correlated feature pairs."),
    "correlation_heatmap": lambda df, q: _report(charts.correlation_matrix(df),
                                                 "Correlation heatmap data generated."),
    "feature_distributions": lambda df, q: _report(charts.distributions(df),
                                                   "Feature distribution data generated.",
                                                   kde=charts.kde(df)),
    "pairplot_visualization": lambda df, q: _report(charts.pair_grid(df), "Pair grid generated.",
                                                    diagonal=charts.pair_grid_diagonal(df)),
    "boxplot_visualization": lambda df, q: _report(charts.box_stats(df), "Box statistics generated."),
    "scatter_plot": lambda df, q: _report(charts.scatter(df), "Scatter data generated."),
    "histogram_plot": lambda df, q: _report(charts.histogram(df), "Histograms generated."),
    "violin_plot": lambda df, q: _report(charts.violin(df), "Violin statistics generated.",
                                          density=charts.violin_density(df)),
    "cleaning_report": lambda df, q: _report(clean.cleaning_report(df),
                                             "Data quality report: missing values and duplicates."),
    "remove_duplicates": _cleaning(clean.remove_duplicates, "Removed duplicates"),
    "fill_missing_mean": _fill(clean.fill_missing_mean, "numeric columns, mean", NUMERIC),
    "fill_missing_median": _fill(clean.fill_missing_median, "numeric columns, median", NUMERIC),
    "fill_missing_mode": _fill(clean.fill_missing_mode, "categorical columns, mode", CATEGORICAL),
    "drop_missing_rows": _cleaning(clean.drop_missing_rows, "Dropped rows with missing values"),
    "remove_outliers": _cleaning(clean.remove_outliers, "Removed outlier rows"),
    "detect_task_type": _task,
    "auto_train_models": _auto_train,
}
