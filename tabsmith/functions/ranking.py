"""Dense codes for the distinct values of a column, in sorted order, without
a global window (``dense_rank() OVER (ORDER BY v)`` runs in one task).

1. distinct values (a pre-aggregated group-by);
2. ``repartitionByRange`` + ``sortWithinPartitions`` -- a sampled range
   partitioner, so the values spread over many tasks in global order; the
   result is checkpointed to the shared folder so every later step sees the
   same partitioning;
3. one small job counts values per partition (one row per partition to the
   driver) and running offsets are folded into a literal map;
4. code = offset[partition] + index within the partition, where the index is
   the low bits of ``monotonically_increasing_id`` taken in sorted order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.session import ensure_checkpoint_dir

ROWS_PER_PARTITION = 1_000_000


def dense_codes(values: DataFrame, value: str, code: str = "code",
                partitions: int | None = None) -> DataFrame:
    """(value, code) with codes 0..n-1 in ascending order of ``value``;
    ``values`` may hold repeats and NULLs (NULLs are dropped)."""
    spark = values.sparkSession
    distinct = values.select(col(value).alias("v")).filter(F.col("v").isNotNull()).distinct()
    n_parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (distinct.repartitionByRange(n_parts, "v").sortWithinPartitions("v")
                       .select("v", F.spark_partition_id().alias("pid"),
                               F.monotonically_increasing_id().alias("mid")))
    if ensure_checkpoint_dir(spark, allow_local=spark.sparkContext.master.startswith("local")):
        ordered = ordered.checkpoint(eager=True)
    else:
        ordered = ordered.persist()
    counts = sorted((r["pid"], r["n"]) for r in
                    ordered.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, run = [], 0
    for pid, n in counts:
        offsets += [F.lit(pid), F.lit(run)]
        run += n
    if not offsets:
        return spark.createDataFrame([], f"{value} string, {code} bigint")
    offset = F.element_at(F.create_map(*offsets), F.col("pid"))
    local = F.col("mid") - F.shiftleft(F.col("pid").cast("bigint"), 33)
    return ordered.select(F.col("v").alias(value), (offset + local).cast("bigint").alias(code))
