"""Cleaning operators (CL0-CL8).

Cleaning operators return the cleaned table itself. Statistics that drive a
fill or a filter are reduced to one small row on the cluster and applied as
literals, so the cleaned table's plan is the input scan plus one projection
or filter -- no cross join and no lineage that grows with the number of
columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.columns import (CATEGORICAL, INTEGRAL_TYPES, NUMERIC, as_double, col,
                                        columns_info)
from tabsmith.functions.quantiles import quantiles
from tabsmith.functions.duplicates import drop_duplicate_rows, duplicate_stats
from tabsmith.functions.frequent import modes
from tabsmith.operators.outliers import keep_test, outlier_plan
from tabsmith.operators.profile import AGG_FIELDS, chunks


def duplicate_count(df: DataFrame) -> DataFrame:
    """CL0: one row (n_rows, distinct_rows, duplicate_rows); exact, with only
    rows of repeated hashes shuffled in full (``functions.duplicates``)."""
    st = duplicate_stats(df)
    return df.sparkSession.createDataFrame(
        [(st.rows, st.distinct, st.duplicates)],
        "n_rows bigint, distinct_rows bigint, duplicate_rows bigint")


def remove_duplicates(df: DataFrame) -> DataFrame:
    """CL1: drop repeated rows (NULL equals NULL; maps are equal when their
    entries are, in any order). Rows whose hash is unique pass through without
    a shuffle; only candidate rows go through ``dropDuplicates``."""
    return drop_duplicate_rows(df)


def _fill(df: DataFrame, values: dict) -> DataFrame:
    """coalesce(c, literal) for the given columns; integral columns that get a
    fractional fill become double (pandas' int-with-NaN is float64)."""
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in values:
            v = values[f.name]
            if isinstance(f.dataType, INTEGRAL_TYPES) and isinstance(v, float):
                c = F.coalesce(c.cast("double"), F.lit(v))
            elif isinstance(f.dataType, T.DecimalType):
                c = F.coalesce(c.cast("double"), F.lit(float(v)))
            else:
                c = F.coalesce(c, F.lit(v).cast(f.dataType))
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def _numeric_fill_stats(df: DataFrame, median: bool) -> dict:
    names = [c.name for c in columns_info(df) if c.cls == NUMERIC]
    if not names:
        return {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        x = as_double(n)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).collect()[0]
    idx = {n: i for i, n in enumerate(names)}
    # columns with a missing cell and at least one value (all-missing stays missing)
    missing = [n for n in names if 0 < row[f"n{idx[n]}"] < row["rows"]]
    if not median:
        return {n: row[f"m{idx[n]}"] for n in missing}
    stats = {n: (row[f"n{idx[n]}"], row[f"lo{idx[n]}"], row[f"hi{idx[n]}"]) for n in missing}
    med = quantiles(df, missing, [0.5], stats)
    return {n: med[(n, 0.5)] for n in missing}


def fill_missing_mean(df: DataFrame) -> DataFrame:
    """CL2: numeric columns with missing cells -> column mean; a column with
    no value at all stays missing."""
    return _fill(df, _numeric_fill_stats(df, median=False))


def fill_missing_median(df: DataFrame) -> DataFrame:
    """CL3: same with the exact median (distributed selection)."""
    return _fill(df, _numeric_fill_stats(df, median=True))


def column_modes(df: DataFrame, names: list[str]) -> dict:
    """Most frequent non-missing value per column, smallest value on ties (``functions.frequent``)."""
    return modes(df, names)


def fill_missing_mode(df: DataFrame) -> DataFrame:
    """CL4: categorical columns with missing cells -> most frequent value
    (``mode()[0]``: smallest value on ties)."""
    cats = [c.name for c in columns_info(df) if c.cls == CATEGORICAL]
    if not cats:
        return df
    row = df.agg(*[F.count_if(col(n).isNull()).alias(f"m{i}") for i, n in enumerate(cats)]).collect()[0]
    with_missing = [n for i, n in enumerate(cats) if row[f"m{i}"] > 0]
    return _fill(df, column_modes(df, with_missing))


def drop_missing_rows(df: DataFrame) -> DataFrame:
    """CL5: drop every row with a missing cell."""
    return df.na.drop(how="any")


# ---------------------------------------------------------------- outliers

#: Columns whose statistics are taken in one pass: each has a mean and a standard
#: deviation (5 buffer fields).
PASS_COLUMNS = AGG_FIELDS // 5


def _moments(df: DataFrame, names: list[str]) -> dict:
    out = {}
    for part in chunks(names, PASS_COLUMNS):
        row = df.agg(*[a for i, n in enumerate(part)
                       for a in (F.avg(as_double(n)).alias(f"m{i}"), F.stddev_samp(as_double(n)).alias(f"s{i}"))]).first()
        out.update({n: (row[f"m{i}"], row[f"s{i}"]) for i, n in enumerate(part)})
    return out


def remove_outliers(df: DataFrame, z: float = 3.0) -> DataFrame:
    """CL6: sequential z-score outlier removal (|z| < z kept, strictly); two
    scans plan it for any number of columns (``operators.outliers``)."""
    pred, _ = outlier_plan(df, z)
    return df.filter(pred)


def remove_outliers_once(df: DataFrame, z: float = 3.0) -> DataFrame:
    """CL6b: every numeric column tested against one set of statistics."""
    names = [c.name for c in columns_info(df) if c.cls == NUMERIC]
    stats = _moments(df, names)
    keeps = [k for k in (keep_test(as_double(n), *stats[n], z) for n in names) if k is not None]
    return df.filter(reduce(lambda a, b: a & b, keeps, F.lit(True)))


# ----------------------------------------------------------------- reports

def cleaning_report(df: DataFrame) -> DataFrame:
    """CL7: per column missing, % (1 dp) and status, with the table's shape,
    duplicate rows and total missing cells on every row."""
    from tabsmith.functions.columns import pct, rows_from_structs
    from tabsmith.operators.profile import table_counts
    info = columns_info(df)
    one = table_counts(df)
    total = reduce(lambda a, b: a + b, [F.col(f"miss_{c.ordinal}") for c in info])
    return rows_from_structs(one, [
        F.struct(F.lit(c.ordinal).cast("bigint").alias("ordinal"), F.lit(c.name).alias("column"),
                 F.col(f"miss_{c.ordinal}").alias("missing"),
                 pct(F.col(f"miss_{c.ordinal}"), F.col("rows"), 1).alias("missing_pct"),
                 F.when(F.col(f"miss_{c.ordinal}") > 0, "warn").otherwise("ok").alias("status"),
                 F.col("rows").alias("n_rows"), F.lit(len(info)).cast("bigint").alias("n_columns"),
                 F.col("dups").alias("duplicate_rows"), total.cast("bigint").alias("missing_cells"))
        for c in info])


def _side_counts(df: DataFrame, side: int, names: list[str]) -> DataFrame:
    # the missing cells of a row are one sum, so that one count serves any number of columns
    cells = reduce(lambda a, b: a + b, [col(n).isNull().cast("int") for n in names], F.lit(0))
    total = F.coalesce(F.sum(cells), F.lit(0))
    return df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).cast("bigint").alias("rows"),
                  total.cast("bigint").alias("missing"))


def cleaning_counts(op: str, before: DataFrame, after: DataFrame,
                    columns: list[str] | None = None) -> DataFrame:
    """CL8: one row (op, rows_before, rows_after, rows_removed, cells_filled).

    ``cells_filled`` = missing cells in ``columns`` before minus after. The two
    one-row counts are unioned and folded (no join).
    """
    names = columns if columns is not None else [
        c for c in before.columns if c in after.columns]
    both = _side_counts(before, 0, names).unionByName(_side_counts(after, 1, names))
    rb = F.max(F.when(F.col("side") == 0, F.col("rows")))
    ra = F.max(F.when(F.col("side") == 1, F.col("rows")))
    mb = F.max(F.when(F.col("side") == 0, F.col("missing")))
    ma = F.max(F.when(F.col("side") == 1, F.col("missing")))
    return both.agg(F.lit(op).alias("op"), rb.alias("rows_before"), ra.alias("rows_after"),
                    (rb - ra).alias("rows_removed"), (mb - ma).cast("bigint").alias("cells_filled"))


def cleaning_counts_all(df: DataFrame, z: float = 3.0) -> DataFrame:
    """CL8 over every cleaning tool applied to the same input."""
    nums = [c.name for c in columns_info(df) if c.cls == NUMERIC]
    cats = [c.name for c in columns_info(df) if c.cls == CATEGORICAL]
    parts = [
        cleaning_counts("remove_duplicates", df, remove_duplicates(df), []),
        cleaning_counts("fill_missing_mean", df, fill_missing_mean(df), nums),
        cleaning_counts("fill_missing_median", df, fill_missing_median(df), nums),
        cleaning_counts("fill_missing_mode", df, fill_missing_mode(df), cats),
        cleaning_counts("drop_missing_rows", df, drop_missing_rows(df), []),
        cleaning_counts("remove_outliers", df, remove_outliers(df, z), []),
    ]
    return reduce(DataFrame.unionByName, parts)
