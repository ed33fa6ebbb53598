"""Dataset profile: summaries, descriptive statistics, top values, correlations.

Design rule P1: all statistics of one operator come from a single ``agg`` whose
one-row result is unpivoted into tidy rows with ``inline``. Exact quantiles use
the distributed selection in ``functions.quantiles``; top values use
pre-aggregated counts of keys of bounded size (``functions.frequent``) and a
per-column ``ORDER BY ... LIMIT k``, never a window over a whole column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.columns import (CATEGORICAL, NUMERIC, as_double, col, columns_info,
                                        pct, rows_from_structs)
from tabsmith.functions.correlation import matrix_corr
from tabsmith.functions.digest import cell
from tabsmith.functions.duplicates import duplicate_stats
from tabsmith.functions.frequent import key_counts, key_of, most_frequent
from tabsmith.functions.quantiles import quantiles
from tabsmith.session import materialize

QUARTILES = (0.25, 0.5, 0.75)
#: Buffer fields of one aggregate pass (a count has 1, a mean 2, a standard
#: deviation 3). Wide tables take several passes, so that each stays within
#: whole-stage code generation.
AGG_FIELDS = 96


def chunks(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def missing_aggs(df: DataFrame) -> list[Column]:
    return [F.count_if(col(c.name).isNull()).cast("bigint").alias(f"miss_{c.ordinal}")
            for c in columns_info(df)]


def missing_counts(df: DataFrame) -> dict[int, int]:
    """Missing cells by column ordinal: one-row aggregates, AGG_FIELDS columns at a time."""
    out: dict[int, int] = {}
    for part in chunks(missing_aggs(df), AGG_FIELDS):
        out.update({int(k.removeprefix("miss_")): v for k, v in df.agg(*part).first().asDict().items()})
    return out


def table_counts(df: DataFrame) -> DataFrame:
    """One row: rows, duplicate rows and missing count per column
    (``miss_<ordinal>``). The hash-based duplicate pass shuffles a hash and a
    count per row; the missing counts are a one-row aggregate beside it."""
    info = columns_info(df)
    st = duplicate_stats(df)
    miss = missing_counts(df)
    values = [st.rows, st.duplicates] + [miss[c.ordinal] for c in info]
    schema = "rows bigint, dups bigint" + "".join(f", miss_{c.ordinal} bigint" for c in info)
    return df.sparkSession.createDataFrame([tuple(values)], schema)


def dataset_summary(df: DataFrame) -> DataFrame:
    """AN1: per column dtype, missing count and % (1 dp), plus rows, columns and
    duplicate rows repeated on every row."""
    info = columns_info(df)
    one = table_counts(df)
    return rows_from_structs(one, [
        F.struct(F.lit(c.ordinal).cast("bigint").alias("ordinal"),
                 F.lit(c.name).alias("column"),
                 F.lit(c.dtype).alias("dtype"),
                 F.col(f"miss_{c.ordinal}").alias("missing"),
                 pct(F.col(f"miss_{c.ordinal}"), F.col("rows"), 1).alias("missing_pct"),
                 F.col("rows").alias("n_rows"),
                 F.lit(len(info)).cast("bigint").alias("n_columns"),
                 F.col("dups").alias("duplicate_rows"))
        for c in info])


DESCRIBE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.LongType()), T.StructField("column", T.StringType()),
    T.StructField("count", T.LongType()), T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()), T.StructField("min", T.DoubleType()),
    T.StructField("p25", T.DoubleType()), T.StructField("p50", T.DoubleType()),
    T.StructField("p75", T.DoubleType()), T.StructField("max", T.DoubleType()),
])


def numeric_moments(df: DataFrame, names: list[str], approx: bool = False) -> dict:
    """Count, mean, sample std, min, max (and approximate quartiles when
    ``approx``) per column -> {name: dict}; one aggregate for some ten columns."""
    out = {}
    for part in chunks(names, AGG_FIELDS // 9):
        aggs = []
        for i, n in enumerate(part):
            x = as_double(n)
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                     F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                     F.max(x).alias(f"hi{i}")]
            if approx:
                aggs.append(F.percentile_approx(x, list(QUARTILES), 10000).alias(f"q{i}"))
        row = df.agg(*aggs).collect()[0]
        for i, n in enumerate(part):
            d = {"count": row[f"n{i}"], "mean": row[f"m{i}"], "std": row[f"s{i}"],
                 "min": row[f"lo{i}"], "max": row[f"hi{i}"]}
            if approx:
                qs = row[f"q{i}"] or [None] * len(QUARTILES)
                d.update({p: v for p, v in zip(QUARTILES, qs)})
            out[n] = d
    return out


def describe_statistics(df: DataFrame, digits: int = 4, approx: bool = False) -> DataFrame:
    """AN2: count, mean, std (ddof 1), min, quartiles (linear), max per numeric
    column, rounded half-to-even. ``approx`` swaps the exact quartiles for
    ``percentile_approx`` (AN2c)."""
    spark = df.sparkSession
    info = [c for c in columns_info(df) if c.cls == NUMERIC]
    if not info:
        return spark.createDataFrame([], DESCRIBE_SCHEMA)
    names = [c.name for c in info]
    mom = numeric_moments(df, names, approx)
    if not approx:
        stats = {n: (mom[n]["count"], mom[n]["min"], mom[n]["max"]) for n in names}
        qv = quantiles(df, names, list(QUARTILES), stats)
        for n in names:
            mom[n].update({p: qv[(n, p)] for p in QUARTILES})
    rows = [(c.ordinal, c.name, mom[c.name]["count"], mom[c.name]["mean"], mom[c.name]["std"],
             mom[c.name]["min"], mom[c.name][0.25], mom[c.name][0.5], mom[c.name][0.75],
             mom[c.name]["max"]) for c in info]
    out = spark.createDataFrame(rows, DESCRIBE_SCHEMA)
    return out.select("ordinal", "column", "count",
                      *[F.bround(c, digits).alias(c) for c in DESCRIBE_SCHEMA.names[3:]])


TOP_VALUES_SCHEMA = ("ordinal bigint, column string, nunique bigint, rank bigint, "
                     "value string, count bigint")


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """AN2b: per categorical column the number of distinct values and its k most
    frequent values with counts (missing excluded)."""
    info = [c for c in columns_info(df) if c.cls == CATEGORICAL]
    if not info:
        return df.sparkSession.createDataFrame([], TOP_VALUES_SCHEMA)
    # one scan and shuffle of keys of bounded size; the texts of the winners alone are fetched
    counts = materialize(key_counts(df, [c.name for c in info]))
    nunique = counts.groupBy("ordinal").agg(F.count(F.lit(1)).cast("bigint").alias("nunique"))
    named = df.sparkSession.createDataFrame([(c.ordinal, c.name) for c in info], "ordinal bigint, column string")
    top = most_frequent(df, [c.name for c in info], counts, k)
    return (top.join(F.broadcast(nunique), "ordinal").join(F.broadcast(named), "ordinal")       # a row a column
               .select("ordinal", "column", "nunique", "rank", "value", "count"))


DESCRIBE_ALL_SCHEMA = ("ordinal bigint, column string, count bigint, unique bigint, "
                       "top string, freq bigint, mean double, std double, min double, "
                       "p25 double, p50 double, p75 double, max double")


def describe_all(df: DataFrame, digits: int = 4) -> DataFrame:
    """AN3: ``describe(include="all")`` -- numeric statistics for numeric
    columns; count, unique, top, freq for categorical and boolean columns."""
    spark = df.sparkSession
    info = columns_info(df)
    text_cols = [c for c in info if c.cls == CATEGORICAL
                 or isinstance(df.schema[c.name].dataType, T.BooleanType)]
    parts = []
    num = describe_statistics(df, digits)
    parts.append(num.select("ordinal", "column", "count",
                            F.lit(None).cast("bigint").alias("unique"),
                            F.lit(None).cast("string").alias("top"),
                            F.lit(None).cast("bigint").alias("freq"),
                            "mean", "std", "min", "p25", "p50", "p75", "max"))
    if text_cols:
        names = [c.name for c in text_cols]
        counts = materialize(key_counts(df, names))
        named = spark.createDataFrame([(c.ordinal, c.name) for c in text_cols], "ordinal bigint, column string")
        # one row a column; read by two branches, so computed once
        per_col = materialize(counts.groupBy("ordinal").agg(F.sum("count").cast("bigint").alias("count"),
                                                            F.count(F.lit(1)).cast("bigint").alias("unique"))
                              .join(F.broadcast(named), "ordinal")
                              .join(most_frequent(df, names, counts, 1)
                                    .select("ordinal", F.col("value").alias("top"), F.col("count").alias("freq")), "ordinal"))
        nulls = [F.lit(None).cast("double").alias(n)
                 for n in ("mean", "std", "min", "p25", "p50", "p75", "max")]
        parts.append(per_col.select("ordinal", "column", "count", "unique", "top", "freq", *nulls))
        # columns with no value at all still get a row
        empty = [c for c in text_cols]
        parts.append(spark.createDataFrame(
            [(c.ordinal, c.name) for c in empty], "ordinal bigint, column string")
            .join(per_col.select("ordinal"), "ordinal", "left_anti")
            .select("ordinal", "column", F.lit(0).cast("bigint").alias("count"),
                    F.lit(0).cast("bigint").alias("unique"), F.lit(None).cast("string").alias("top"),
                    F.lit(None).cast("bigint").alias("freq"), *nulls))
    return reduce(DataFrame.unionByName, parts)


PAIR_SCHEMA = "i bigint, j bigint, col_x string, col_y string, r double, abs_r double"


def correlation_all(df: DataFrame) -> tuple[list[str], dict[tuple[int, int], float | None]]:
    """The numeric columns and r of all their pairs i <= j, from one pass."""
    names = [c.name for c in columns_info(df) if c.cls == NUMERIC]
    return names, matrix_corr(df, names) if len(names) > 1 else {}


def correlation_long(df: DataFrame) -> DataFrame:
    """All numeric pairs i<j: (i, j, col_x, col_y, r, abs_r), in one pass for any number of columns."""
    names, r = correlation_all(df)
    rows = [(i + 1, j + 1, names[i], names[j], v, None if v is None else abs(v)) for (i, j), v in r.items() if i < j]
    return df.sparkSession.createDataFrame(rows, PAIR_SCHEMA)


def correlation_pairs(df: DataFrame, k: int = 10) -> DataFrame:
    """AN4: the k numeric pairs with the largest |Pearson r| (pairwise deletion)."""
    return (correlation_long(df)
            .orderBy(F.col("abs_r").desc_nulls_last(), "i", "j").limit(k))


def nunique(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """AN5: distinct non-missing values per column: (ordinal, column, nunique)."""
    info = [c for c in columns_info(df)
            if (columns is None or c.name in columns)
            and not isinstance(df.schema[c.name].dataType, T.MapType)]
    if not info:
        return df.sparkSession.createDataFrame([], "ordinal bigint, column string, nunique bigint")
    # one scan for all columns; a cell travels as a key of bounded size, its column in front
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c.ordinal).cast("bigint").alias("ordinal"),
                                                  key_of(_cell_text(df, c.name)).alias("key")) for c in info])))
    counts = (cells.where(F.col("key").isNotNull()).groupBy("ordinal", "key").agg(F.lit(1).alias("one"))
              .groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")))            # a row a column
    named = df.sparkSession.createDataFrame([(c.ordinal, c.name) for c in info], "ordinal bigint, column string")
    return named.join(F.broadcast(counts), "ordinal", "left").select(
        "ordinal", "column", F.coalesce("n", F.lit(0)).cast("bigint").alias("nunique"))


def _cell_text(df: DataFrame, name: str) -> Column:
    """A text (or binary) that differs wherever the cells of a column do."""
    if isinstance(df.schema[name].dataType, T.TimestampType):      # two instants may print alike
        return F.unix_micros(col(name)).cast("string")
    c = cell(df, name)
    return c if isinstance(df.schema[name].dataType, T.BinaryType) else c.cast("string")
