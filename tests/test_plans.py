"""Physical-plan shape: the scale properties the operators are built for."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from tabsmith.functions import correlation
from tabsmith.operators import charts, clean, profile, querylog
from tabsmith.sources import fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern, text):
    return len(re.findall(pattern, text))


@pytest.fixture(scope="module")
def dirty(spark):
    return fx.dirty_lineitem(spark, SF0001)


def test_cleaned_tables_are_scan_project_filter(dirty):
    for op in (clean.fill_missing_mean, clean.fill_missing_median, clean.fill_missing_mode,
               clean.remove_outliers, clean.remove_outliers_once, clean.drop_missing_rows):
        p = plan(op(dirty))
        # the fixture's own union is the only structure: no exchange, no join
        assert "Exchange" not in p and "Join" not in p, op.__name__


def test_correlation_is_one_pass(spark, dirty, monkeypatch):
    """The sums of one pass give every pair; none is taken again."""
    def again(*a):
        raise AssertionError("a pair was taken again")
    monkeypatch.setattr(correlation, "pair_corr", again)
    wide = spark.range(200).select(*[((F.col("id") * (k + 7)) % 101).cast("double").alias(f"c{k}") for k in range(30)])
    for frame, n in ((dirty, 6), (wide, 30)):
        assert profile.correlation_long(frame).count() == n * (n - 1) // 2


def test_kde_broadcasts_parameters_no_cross_join(spark):
    ev = fx.events(spark, SF0001)
    p = plan(charts.kde(ev))
    assert "BroadcastHashJoin" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "SortMergeJoin" not in p


def test_histogram_single_shuffle_of_counts(spark):
    ev = fx.events(spark, SF0001)
    p = plan(charts.histogram(ev))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_routing_rules_are_narrow(spark):
    p = plan(querylog.fallback_tools(querylog.route(fx.query_log(spark, SF0001))))
    assert "Exchange" not in p and "PythonUDF" not in p and "BatchEvalPython" not in p


def test_no_python_udfs_anywhere(spark, dirty):
    ev = fx.events(spark, SF0001)
    frames = [profile.top_values(dirty), clean.cleaning_report(dirty), charts.pair_grid(ev),
              charts.violin(ev), querylog.conversation_turns(fx.turn_log(spark, SF0001))]
    for f in frames:
        p = plan(f)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_prunes_columns(spark):
    ev = fx.events(spark, SF0001)
    p = plan(charts.histogram(ev, 20, ["value"]))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", p) or re.findall(r"FileScan parquet \[([^\]]*)\]", p)
    assert read and all("props" not in r for r in read)
