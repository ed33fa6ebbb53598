"""Dataset handle and table-level helpers (IO5-IO11)."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.columns import col, columns_info
from tabsmith.functions.digest import frame_digest
from tabsmith.functions.duplicates import key_exprs
from tabsmith.session import scratch_path
from tabsmith.sources.csv import labels_frame


@dataclass(frozen=True)
class Dataset:
    """IO5: a named, versioned frame (no global state)."""
    name: str
    version: int
    df: DataFrame
    path: str | None = None
    paths: tuple[str, ...] = ()         # the folders whose files make up the version


def as_dataset(df: DataFrame, name: str = "dataset") -> Dataset:
    """IO5: string labels made unique, version 0."""
    return Dataset(name, 0, labels_frame(df))


def save_version(ds: Dataset, new_df: DataFrame, root: str | None = None) -> Dataset:
    """IO10: the next version; written as Parquet under the shared folder
    (``root`` or ``spark.checkpoint.dir``) and read back, which also cuts
    the lineage of a long cleaning chain."""
    base = root or scratch_path(new_df.sparkSession, f"dataset-{ds.name}")
    path = os.path.join(base, f"v={ds.version + 1}")
    new_df.write.mode("overwrite").parquet(path)
    return replace(ds, version=ds.version + 1, df=new_df.sparkSession.read.parquet(path), path=path, paths=(path,))


def append_version(ds: Dataset, rows: DataFrame, root: str | None = None) -> Dataset:
    """IO10: the next version is this one with ``rows`` added. Only they are written, to a folder of
    their own; a saved version's files are shared, so what was computed from them still holds."""
    if not ds.paths:
        ds = save_version(ds, ds.df, root)
    if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in ds.df.schema]:
        raise ValueError("the added rows have other columns than the dataset")
    spark = rows.sparkSession
    base = root or scratch_path(spark, f"dataset-{ds.name}")
    path = os.path.join(base, f"v={ds.version + 1}")
    rows.write.mode("overwrite").parquet(path)
    paths = (*ds.paths, path)
    return replace(ds, version=ds.version + 1, df=read_version(spark, ds.df.schema, paths), path=path, paths=paths)


def read_version(spark: SparkSession, schema: T.StructType, paths: tuple[str, ...] | list[str]) -> DataFrame:
    """The rows of all files of the folders or files ``paths``."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)


def frames_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """IO11: multiset comparison -- one row (differs, rows_a, rows_b,
    only_in_a, only_in_b). Frames of one digest (one pass each, no shuffle) are
    equal; rows are shuffled, once, only when the digests differ. A schema
    mismatch alone already means different."""
    counts = "differs boolean, rows_a bigint, rows_b bigint, only_in_a bigint, only_in_b bigint"
    if [f.dataType for f in a.schema] != [f.dataType for f in b.schema] or a.columns != b.columns:
        na, nb = a.count(), b.count()
        return a.sparkSession.createDataFrame([(True, na, nb, na, nb)], counts)
    digest = frame_digest(a)
    if digest == frame_digest(b):
        return a.sparkSession.createDataFrame([(False, digest[0], digest[0], 0, 0)], counts)
    # one pass: each distinct row's count in a less its count in b, pre-aggregated
    # before the one shuffle; maps are compared by their entries
    def side(df, na, nb):
        return df.select(*key_exprs(df), F.lit(na).cast("bigint").alias("na"), F.lit(nb).cast("bigint").alias("nb"))
    both = side(a, 1, 0).unionByName(side(b, 0, 1))
    d = both.groupBy(*[f"__k{i}" for i in range(len(a.columns))]).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    zero = F.lit(0).cast("bigint")
    def total(c):
        return F.coalesce(F.sum(c), zero)
    return d.agg((total(F.abs(F.col("na") - F.col("nb"))) > 0).alias("differs"), total("na").alias("rows_a"),
                 total("nb").alias("rows_b"), total(F.greatest(F.col("na") - F.col("nb"), zero)).alias("only_in_a"),
                 total(F.greatest(F.col("nb") - F.col("na"), zero)).alias("only_in_b"))


def decode_labels(df: DataFrame, code_col: str, labels: DataFrame, label_code: str,
                  label_name: str, out: str | None = None) -> DataFrame:
    """IO6: add the name of each code from a label table (left join). The
    optimizer broadcasts the label table when its bytes are few."""
    lab = labels.select(col(label_code).alias("__code"), col(label_name).alias(out or label_name))
    return df.join(lab, col(code_col) == F.col("__code"), "left").drop("__code")


def preview(df: DataFrame, n: int = 8, key: list[str] | None = None) -> DataFrame:
    """IO7: the first ``n`` rows by ``key`` (all columns when not given) --
    a bounded top-n, not a full sort."""
    order = key or df.columns
    return df.orderBy(*[col(c).asc_nulls_first() for c in order]).limit(n)


def records_json(df: DataFrame, n: int = 5, key: list[str] | None = None) -> DataFrame:
    """IO8: the preview rows as JSON records."""
    return preview(df, n, key).select(F.to_json(F.struct(*[col(c) for c in df.columns]))
                                      .alias("record"))


def column_list(df: DataFrame) -> DataFrame:
    """IO9: (ordinal, column, type) from the schema."""
    return df.sparkSession.createDataFrame(
        [(c.ordinal, c.name, c.dtype) for c in columns_info(df)],
        "ordinal bigint, column string, type string")
