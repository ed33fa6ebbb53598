"""Profiles that are kept and merged instead of computed again (AN1, AN2c, SC4, IO10).

A *state* describes one column of one part of a table (a file, a group, a batch) in a
few kilobytes: rows, values, mean, squared deviations, least and largest value, a
quantile sketch (KLL) and a distinct-count sketch (HyperLogLog). States of parts
merge into the state of the whole:

* counts, least and largest values are exact; mean and deviation merge about the
  common mean, so no digits are lost however far the parts' means lie apart;
* a quantile's rank is within RANK_ERROR of the rank asked for (99 % of cases),
  and the distinct count within DISTINCT_ERROR (one standard error), for any data,
  skewed or tied, and for any order or number of merges.

``VersionProfile`` keeps the states of a dataset's files in a folder, with each file's
row hashes, from which duplicate rows are counted exactly over all files. A new version
reads only the files that no earlier update has seen: a file is known by path, size and
time of change. The folder's ``commits`` are written last and one file at a time becomes
visible with them, so an update that fails leaves nothing behind that counts, and two
updates of one file count once.

Defined cases: missing cells (also NaN) count as missing; a column without values, or
not numeric, has null moments and quantiles; an empty table has rows of zeros.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.columns import NUMERIC, as_double, col, columns_info, normalize_missing, pct
from tabsmith.functions.digest import cell, row_hashes
from tabsmith.operators.profile import QUARTILES, chunks
from tabsmith.sources.dataset import Dataset, read_version

KLL_K = 1024
RANK_ERROR = 2.296 / KLL_K ** 0.9723        # published bound of the sketch, 0.27 %
HLL_BITS = 12
DISTINCT_ERROR = 1.04 / 2 ** (HLL_BITS / 2)     # 1.6 %
#: Columns described in one pass (a state holds some 20 kB a column and part).
PASS_COLUMNS = 16
MOMENTS = ("count", "mean", "m2", "min", "max")
STATE = ("ordinal", "column", "rows", *MOMENTS, "quantiles", "distinct")


def _state_of(df: DataFrame, c, i: int) -> list[Column]:
    """The aggregates of one column, numbered ``i``."""
    present = F.count(col(c.name)).alias(f"count_{i}")
    seen = F.hll_sketch_agg(F.when(col(c.name).isNotNull(), F.xxhash64(cell(df, c.name))), HLL_BITS).alias(f"distinct_{i}")
    if c.cls != NUMERIC:
        return [present, seen]
    x = as_double(c.name)
    return [present, seen, F.avg(x).alias(f"mean_{i}"), (F.var_pop(x) * F.count(x)).alias(f"m2_{i}"),
            F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"), F.kll_sketch_agg_double(x, KLL_K).alias(f"quantiles_{i}")]


def column_states(df: DataFrame, by: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """One state per column and value of ``by``: (by..., ordinal, column, rows, ...)."""
    df = normalize_missing(df)
    info = [c for c in columns_info(df) if c.name not in by and (columns is None or c.name in columns)]
    parts = []
    for some in chunks(info, PASS_COLUMNS):
        aggs = [a for i, c in enumerate(some) for a in _state_of(df, c, i)]
        one = df.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("rows"), *aggs)

        def state(i, c):
            kinds = {"quantiles": "binary", "count": "bigint"}
            fields = [F.col(f"{f}_{i}") if c.cls == NUMERIC or f == "count" else F.lit(None)
                      for f in (*MOMENTS, "quantiles")]
            named = [v.cast(kinds.get(f, "double")).alias(f) for f, v in zip((*MOMENTS, "quantiles"), fields)]
            return F.struct(F.lit(c.ordinal).cast("bigint").alias("ordinal"), F.lit(c.name).alias("column"),
                            F.col("rows"), *named, F.col(f"distinct_{i}").alias("distinct"))
        parts.append(one.select(*[col(b) for b in by], F.inline(F.array(*[state(i, c) for i, c in enumerate(some)]))))
    return reduce(DataFrame.unionByName, parts)


def merge_states(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The states of the parts put together, one per column and value of ``by``."""
    keys = [*by, "ordinal", "column"]
    held = F.when(F.col("count") > 0, F.col("count").cast("double"))
    mean = F.sum(held * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), held))
    own = {k: f"_of{i}" for i, k in enumerate(keys)}
    centre = states.groupBy(*[col(k).alias(own[k]) for k in keys]).agg(mean.alias("centre"))
    same = [col(k).eqNullSafe(F.col(own[k])) for k in keys]
    around = states.join(centre, reduce(lambda a, b: a & b, same)).drop(*own.values())
    off = F.col("m2") + held * F.pow(F.col("mean") - F.col("centre"), 2)
    return around.groupBy(*[col(k) for k in keys]).agg(
        F.sum("rows").alias("rows"), F.sum("count").alias("count"), F.first("centre").alias("mean"), F.sum(off).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"))


def describe_states(merged: DataFrame) -> DataFrame:
    """Statistics from states: (by..., ordinal, column, rows, count, mean, std, min, p25, p50, p75, max, distinct);
    quartiles and distinct counts within the errors above."""
    keys = [c for c in merged.columns if c not in STATE]
    known = (F.col("count") > 0) & F.col("mean").isNotNull()
    cuts = F.when(known, F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(q) for q in QUARTILES])))
    return merged.withColumn("cuts", cuts).select(
        *keys, "ordinal", "column", "rows", "count", "mean",
        F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1))).alias("std"), "min",
        *[F.get("cuts", F.lit(i)).alias(f"p{int(100 * q)}") for i, q in enumerate(QUARTILES)], "max",
        F.hll_sketch_estimate("distinct").alias("distinct"))


# ----------------------------------------------------------------- a dataset's versions

def _mark() -> Column:
    """What a file is known by: its path, size and time of change."""
    return F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.file_size").cast("string"),
                       F.unix_micros("_metadata.file_modification_time").cast("string"))


def version_files(spark: SparkSession, ds: Dataset) -> DataFrame:
    """(file, path) of the files of a saved version; their content is not read."""
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
              .option("recursiveFileLookup", "true").load(list(ds.paths)))
    return listed.select(_mark().alias("file"), F.col("path"))


@dataclass(frozen=True)
class VersionProfile:
    """The kept states of a dataset's files, under the shared folder ``root``."""
    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(os.path.join(self.root, name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)       # nothing kept yet

    def _commits(self) -> DataFrame:
        """(file, run): the one update that counts for each file."""
        return self._read("commits", "file string, run string").groupBy("file").agg(F.min("run").alias("run"))

    def update(self, ds: Dataset) -> int:
        """Describe the files of ``ds`` that are not known yet; returns how many."""
        if not ds.paths:
            raise ValueError("only a saved version has files")
        new = version_files(self.spark, ds).join(self._commits(), "file", "left_anti").collect()   # a name a file
        if not new:
            return 0
        run = f"r{uuid.uuid4().hex}"
        rows = read_version(self.spark, ds.df.schema, [r.path for r in new])
        names = rows.columns
        mark = "file"
        while mark in names:
            mark = "_" + mark
        marked = rows.select("*", _mark().alias(mark))
        first, second = row_hashes(rows)
        hashes = (marked.select(col(mark).alias("file"), first.alias("h1"), second.alias("h2")).groupBy("file", "h1", "h2")
                  .agg(F.count(F.lit(1)).alias("n")))
        states = column_states(marked, (mark,)).withColumnRenamed(mark, "file")
        hashes.write.parquet(os.path.join(self.root, "hashes", f"run={run}"))
        states.write.parquet(os.path.join(self.root, "states", f"run={run}"))
        # last, and as one file: the update counts from here on
        done = self.spark.createDataFrame([(r.file,) for r in new], "file string").coalesce(1)
        done.write.parquet(os.path.join(self.root, "commits", f"run={run}"))
        return len(new)

    def _of(self, ds: Dataset, name: str, schema: str) -> DataFrame:
        """What is kept of the files of ``ds``."""
        chosen = version_files(self.spark, ds).select("file").join(self._commits(), "file")
        return self._read(name, f"{schema}, run string").join(chosen, ["file", "run"]).drop("run")

    def states(self, ds: Dataset) -> DataFrame:
        schema = ("file string, ordinal bigint, column string, rows bigint, count bigint, mean double, m2 double, "
                  "min double, max double, quantiles binary, distinct binary")
        return self._of(ds, "states", schema)

    def duplicates(self, ds: Dataset) -> DataFrame:
        """One row (rows, duplicate_rows) over all files of ``ds``, from their rows' hashes."""
        rows = self._of(ds, "hashes", "file string, h1 bigint, h2 bigint, n bigint")
        zero = F.lit(0).cast("bigint")
        return (rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
                .agg(F.coalesce(F.sum("n"), zero).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicate_rows")))

    def profile(self, ds: Dataset) -> DataFrame:
        """The summary and statistics of every column of ``ds`` (a saved version), reading only files not seen before.

        Columns: ordinal, column, dtype, missing, missing_pct, n_rows, n_columns, duplicate_rows, count, mean, std,
        min, max (as a full profile has them), p25, p50, p75, distinct (within the sketches' errors)."""
        self.update(ds)
        info = columns_info(ds.df)
        named = self.spark.createDataFrame([(c.ordinal, c.name, c.dtype) for c in info],
                                           T.StructType([T.StructField("ordinal", T.LongType()),
                                                         T.StructField("column", T.StringType()),
                                                         T.StructField("dtype", T.StringType())]))
        stats = describe_states(merge_states(self.states(ds))).drop("column")       # a row a column
        total = self.duplicates(ds)                                                # one row
        return (named.join(F.broadcast(stats), "ordinal", "left").join(F.broadcast(total))
                .select("ordinal", "column", "dtype",
                        F.coalesce(F.col("rows") - F.col("count"), F.lit(0)).cast("bigint").alias("missing"),
                        pct(F.coalesce(F.col("rows") - F.col("count"), F.lit(0)), F.col("n_rows"), 1).alias("missing_pct"),
                        "n_rows", F.lit(len(info)).cast("bigint").alias("n_columns"), "duplicate_rows",
                        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "mean", "std", "min", "max",
                        "p25", "p50", "p75", "distinct"))
