"""Parquet table loading (the driver's generated tables)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tabsmith.functions.columns import normalize_missing

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str, normalize: bool = True) -> DataFrame:
    """Read one table; NaN -> NULL on float columns (a projection, pushdown kept)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return normalize_missing(df) if normalize else df


def load_parquet(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    return normalize_missing(df) if normalize else df


def stream_parquet(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The rows of a Parquet table, one file or a folder of files, as a stream.

    Spark streams folders or patterns: a pattern that only ``path`` fits finds either, on any file system."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = path.rstrip("/")
    if not set(path) & set("*?[]{}\\"):
        path = f"{path[:-1]}[{path[-1]}]"
    return reader.parquet(path)
