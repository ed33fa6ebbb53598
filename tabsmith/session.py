"""Session helpers.

Library code never picks machine-local folders on its own: the shared folder
comes from ``spark.checkpoint.dir``. Only ``local_session`` (tests, bench,
local runs) fills that setting in when it is unset.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHIPPING = threading.Lock()


def local_session(cores: int | str = "*", partitions: int = 8,
                  app: str = "tabsmith") -> SparkSession:
    """A local session configured the way the library expects a cluster to be."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABSMITH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # let AQE coalesce the partitions of cached plans (materialised
        # intermediate tables are small next to the default shuffle width)
        .config("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local=True)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, allow_local: bool = False) -> str | None:
    """Return the shared checkpoint folder named by the session.

    When the session names none, a fresh local folder is made only if
    ``allow_local`` (tests and local runs); on a cluster the caller gets None
    and falls back to plans that need no materialisation.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path and allow_local:
        path = tempfile.mkdtemp(prefix="tabsmith-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    sc = spark.sparkContext
    if path and getattr(sc, "_tabsmith_checkpoints", None) != path:
        sc.setCheckpointDir(path)           # makes a subfolder, so once a context
        sc._tabsmith_checkpoints = path
    return path or None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark, allow_local=spark.sparkContext.master.startswith("local"))
    if not base:
        raise RuntimeError(f"{CHECKPOINT_CONF} is not set; a shared folder is required")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per Spark context, for
    functions that run in tasks and use its modules."""
    sc = spark.sparkContext
    with SHIPPING:                      # fits run in several threads
        if getattr(sc, "_tabsmith_shipped", False):
            return
        package = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tabsmith-py-"), "tabsmith_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for name in (n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)                  # Spark serves the archive to every executor
        sc._tabsmith_shipped = True


SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, a query's shuffle files go when the query ends (Spark 4.1; it else waits until the driver collects
    garbage). For work of many queries, each run once. The session's own setting holds again afterwards."""
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_CONF)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_CONF, before)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def save_once(df, name: str):
    """``df`` written to the shared folder and read back: computed once, and no lineage behind it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df):
    """Compute ``df`` once and cut its lineage: a reliable checkpoint in the
    shared folder (survives executor loss), or a persisted copy when the
    session names no shared folder. Used where a plan would otherwise be
    recomputed several times (a shuffle join or an aggregate read by several
    branches)."""
    if ensure_checkpoint_dir(df.sparkSession, allow_local=is_local(df.sparkSession)):
        # a reliable checkpoint runs one job to compute and another to write;
        # with the rows cached, the write job reads them instead of
        # recomputing the plan
        cached = df.persist()
        out = cached.checkpoint(eager=True)
        cached.unpersist()
        return out
    df = df.persist()
    df.count()          # evaluate now, like the eager checkpoint
    return df
