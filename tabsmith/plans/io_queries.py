"""Registered ingestion and dataset queries (IO1-IO11), on frames derived
from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.columns import round_doubles
from tabsmith.operators import clean
from tabsmith.operators.profile_state import VersionProfile, column_states, describe_states, merge_states
from tabsmith.session import scratch_path
from tabsmith.sources import dataset as ds
from tabsmith.sources import fixtures as fx
from tabsmith.sources.csv import labels_frame, load_csv, require_nonempty, write_csv
from tabsmith.sources.tables import load_table

LINEITEM_KEY = ["l_orderkey", "l_linenumber"]


def q_load_csv(spark: SparkSession, sf: str) -> DataFrame:
    """IO1: the dirty_lineitem frame written as CSV, then read back with the
    pandas-like rules (types re-inferred from text)."""
    path = write_csv(fx.dirty_lineitem(spark, sf), scratch_path(spark, "dirty-csv"))
    return round_doubles(load_csv(spark, path))


def q_load_csv_strict(spark, sf):
    """IO2: comma only, failing on long rows."""
    path = write_csv(fx.dirty_lineitem(spark, sf), scratch_path(spark, "dirty-csv"))
    return round_doubles(load_csv(spark, path, seps=(",",), on_bad="fail"))


def q_load_csv_texts(spark, sf):
    """IO1: whole document texts (quotes, commas, line breaks) written as CSV and read back."""
    docs = load_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return load_csv(spark, write_csv(docs, scratch_path(spark, "texts-csv"), whole_texts=True))


def q_normalize_labels(spark, sf):
    """IO3: a projection that repeats labels, made unique."""
    li = load_table(spark, sf, "lineitem")
    dup = li.select(F.col("l_orderkey"), F.col("l_partkey").alias("l_orderkey"),
                    F.col("l_suppkey").alias("l_orderkey"), F.col("l_linenumber"))
    return labels_frame(dup)


def q_require_nonempty(spark, sf):
    return require_nonempty(load_table(spark, sf, "orders"))


def q_decode_labels(spark, sf):
    """IO6: nation's region code decoded to the region name."""
    nation = load_table(spark, sf, "nation")
    region = load_table(spark, sf, "region")
    return ds.decode_labels(nation, "n_regionkey", region, "r_regionkey", "r_name", "region_name")


def q_preview(spark, sf):
    return round_doubles(ds.preview(load_table(spark, sf, "lineitem"), 8, LINEITEM_KEY))


def q_records_json(spark, sf):
    return ds.records_json(load_table(spark, sf, "lineitem"), 5, LINEITEM_KEY)


def q_column_list(spark, sf):
    return ds.column_list(load_table(spark, sf, "lineitem"))


def q_save_version(spark, sf):
    """IO10: the de-duplicated frame saved as version 1 and read back."""
    d = ds.as_dataset(fx.dirty_lineitem(spark, sf), "dirty_lineitem")
    v1 = ds.save_version(d, clean.remove_duplicates(d.df))
    return round_doubles(v1.df)


def q_frames_differ(spark, sf):
    d = fx.dirty_lineitem(spark, sf)
    return ds.frames_differ(d, clean.remove_duplicates(d))


#: The statistics of a kept profile that are exact.
EXACT = ("count", "mean", "std", "min", "max")


def q_profile_versions(spark, sf):
    """IO10, AN1, AN2: dirty_lineitem grows over three versions; each update describes the new files alone,
    and the last version's profile is put together from what is kept."""
    rows = fx.dirty_lineitem(spark, sf)
    third = F.pmod("l_orderkey", F.lit(3))
    kept = VersionProfile(spark, scratch_path(spark, "profile"))
    version = ds.save_version(ds.as_dataset(rows, "dirty_lineitem"), rows.where(third == 0))
    for k in (1, 2):
        kept.update(version)
        version = ds.append_version(version, rows.where(third == k))
    return round_doubles(kept.profile(version).select(
        "ordinal", "column", "dtype", "missing", "missing_pct", "n_rows", "n_columns", "duplicate_rows", *EXACT))


def q_describe_rollup(spark, sf):
    """AN2c: states of every event type and day, merged into states of the event types."""
    ev = fx.events(spark, sf).select("event_type", F.to_date("ts").alias("day"), "value")
    states = column_states(ev, ("event_type", "day"))
    return round_doubles(describe_states(merge_states(states, ("event_type",))).select(
        "event_type", "column", "rows", *EXACT))


def io_queries() -> dict:
    return {
        "load_csv": q_load_csv,
        "load_csv_strict": q_load_csv_strict,
        "load_csv_texts": q_load_csv_texts,
        "normalize_labels": q_normalize_labels,
        "require_nonempty": q_require_nonempty,
        "decode_labels": q_decode_labels,
        "preview": q_preview,
        "records_json": q_records_json,
        "column_list": q_column_list,
        "save_version": q_save_version,
        "frames_differ": q_frames_differ,
        "profile_versions": q_profile_versions,
        "describe_rollup": q_describe_rollup,
    }
