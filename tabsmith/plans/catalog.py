"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each entry runs one operator over a frame derived from the driver's tables
(``sources.fixtures``). Results are presented with doubles rounded
half-to-even to 4 decimals, the convention shared with the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.columns import round_doubles
from tabsmith.operators import profile, schema
from tabsmith.operators import charts, clean
from tabsmith.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
DENSITY = {"density": 8}


def _on(source, op, digits: dict | None = None, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(op(source(spark, sf_dir), **kw), per_column=digits)
    run.__name__ = getattr(op, "__name__", "query")
    return run


def _table(name):
    def load(spark, sf):
        from tabsmith.sources.tables import load_table
        return load_table(spark, sf, name)
    return load


def _map_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL1 on rows that differ in a map column alone."""
    li = _table("lineitem")(spark, sf_dir)
    rows = li.select((F.col("l_orderkey") % 50).alias("k"), F.create_map("l_returnflag", "l_linenumber").alias("m"))
    return clean.remove_duplicates(rows).select("k", F.map_keys("m")[0].alias("flag"), F.map_values("m")[0].alias("number"))


def queries() -> dict[str, Query]:
    from tabsmith.plans.io_queries import io_queries
    from tabsmith.plans.ml_queries import ml_queries
    from tabsmith.plans.sessions import session_queries
    from tabsmith.plans.querylog_queries import querylog_queries
    dirty = fx.dirty_lineitem
    ev = fx.events
    return {
        # schema and profile
        "dataset_summary": _on(dirty, profile.dataset_summary),
        "describe_statistics": _on(dirty, profile.describe_statistics),
        "describe_statistics_approx": _on(dirty, profile.describe_statistics, approx=True),
        "top_values": _on(dirty, profile.top_values),
        "describe_all": _on(dirty, profile.describe_all),
        "correlation_pairs": _on(dirty, profile.correlation_pairs),
        "nunique": _on(dirty, profile.nunique),
        "column_classes": _on(dirty, schema.column_classes),
        "extract_schema": _on(dirty, schema.extract_schema),
        "schema_text": _on(dirty, schema.schema_text),
        "rich_schema": _on(dirty, schema.rich_schema),
        "summary_counters": _on(dirty, schema.summary_counters),
        "describe_numeric": _on(dirty, schema.describe_numeric),
        "dataset_intelligence": _on(dirty, schema.dataset_intelligence),
        "duplicate_count": _on(dirty, clean.duplicate_count),
        # other driver tables: an array column (class "other"), long texts
        "dataset_summary_embeddings": _on(_table("embeddings"), profile.dataset_summary),
        "dataset_summary_documents": _on(_table("documents"), profile.dataset_summary),
        "top_values_documents": _on(_table("documents"), profile.top_values),
        # cleaning
        "remove_duplicates": _on(dirty, clean.remove_duplicates),
        "remove_duplicates_maps": _map_duplicates,
        "fill_missing_mean": _on(dirty, clean.fill_missing_mean),
        "fill_missing_median": _on(dirty, clean.fill_missing_median),
        "fill_missing_mode": _on(dirty, clean.fill_missing_mode),
        "drop_missing_rows": _on(dirty, clean.drop_missing_rows),
        "remove_outliers": _on(dirty, clean.remove_outliers),
        "remove_outliers_events": _on(fx.events, clean.remove_outliers),
        "remove_outliers_once": _on(dirty, clean.remove_outliers_once),
        "cleaning_report": _on(dirty, clean.cleaning_report),
        "cleaning_counts": _on(dirty, clean.cleaning_counts_all),
        # chart data
        "correlation_matrix": _on(dirty, charts.correlation_matrix),
        "histogram": _on(ev, charts.histogram),
        "distributions": _on(ev, charts.distributions),
        "kde": _on(ev, charts.kde, digits=DENSITY),
        "box_stats": _on(ev, charts.box_stats),
        "scatter": _on(ev, charts.scatter),
        "pair_grid": _on(ev, charts.pair_grid),
        "pair_grid_diagonal": _on(ev, charts.pair_grid_diagonal, digits=DENSITY),
        "violin": _on(ev, charts.violin),
        "violin_density": _on(ev, charts.violin_density, digits=DENSITY),
        "group_by_category": _on(ev, charts.group_by_category),
        "bar_counts": _on(ev, charts.bar_counts, cat="event_type"),
        "line_series": _on(ev, charts.line_series, ts="ts", value="value"),
        "trend": _on(ev, charts.trend, ts="ts", value="value"),
        # query log
        **querylog_queries(),
        # machine learning
        **ml_queries(),
        # ingestion and dataset handling
        **io_queries(),
        # session walkthroughs (rows-only check)
        **session_queries(),
    }
