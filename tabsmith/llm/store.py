"""Shared storage of intermediate tables.

Intermediate results live in the folder that ``spark.checkpoint.dir`` names,
which the driver and all executors share, so they survive lost executors. A
local folder is made only in local mode when the setting is empty (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from tabsmith.session import CHECKPOINT_CONF, is_local


_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tabsmith_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tabsmith-py-"), "tabsmith_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    sc._tabsmith_shipped = True


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not is_local(spark):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tabsmith-llm-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's own setting: an execution's shuffle files go when it ends, not when the driver's memory is cleaned.
FREE_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, free_shuffle: bool = False) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, and the file sizes
    let the optimizer choose joins by bytes. ``free_shuffle`` gives the shuffle
    files behind it back, which nothing needs once the table is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLE, None)
    if free_shuffle:
        spark.conf.set(FREE_SHUFFLE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free_shuffle:
            spark.conf.unset(FREE_SHUFFLE) if before is None else spark.conf.set(FREE_SHUFFLE, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken, name: str) -> str:
    """``name``, with underscores in front until it clashes with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
