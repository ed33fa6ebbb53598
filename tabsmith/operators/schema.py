"""Schema extraction and dataset-level counters (SC1-SC6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import (CATEGORICAL, NUMERIC, columns_info, pct,
                                        rows_from_structs)
from tabsmith.operators.profile import (describe_all, describe_statistics, missing_aggs,
                                        table_counts)


def column_classes(df: DataFrame) -> DataFrame:
    """SC1: (ordinal, column, dtype, class) from the schema alone (no job)."""
    rows = [(c.ordinal, c.name, c.dtype, c.cls) for c in columns_info(df)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal bigint, column string, dtype string, class string")


def extract_schema(df: DataFrame) -> DataFrame:
    """SC2: rows, columns, dtype, class and missing count per column, one pass."""
    info = columns_info(df)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *missing_aggs(df))
    return rows_from_structs(one, [
        F.struct(F.lit(c.ordinal).cast("bigint").alias("ordinal"), F.lit(c.name).alias("column"),
                 F.lit(c.dtype).alias("dtype"), F.lit(c.cls).alias("class"),
                 F.col(f"miss_{c.ordinal}").alias("missing"),
                 F.col("rows").alias("n_rows"),
                 F.lit(len(info)).cast("bigint").alias("n_columns"))
        for c in info])


def _names_or_none(names: list[str]) -> str:
    return ", ".join(names) if names else "None"


def schema_text(df: DataFrame) -> DataFrame:
    """SC3: the compact schema text as ordered lines (line_no, text)."""
    info = columns_info(df)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *missing_aggs(df))
    head = [
        F.format_string("Dataset: %d rows × %d columns", F.col("rows"), F.lit(len(info))),
        F.lit("Columns: " + ", ".join(c.name for c in info)),
        F.lit("Numeric columns: " + _names_or_none([c.name for c in info if c.cls == NUMERIC])),
        F.lit("Categorical columns: "
              + _names_or_none([c.name for c in info if c.cls == CATEGORICAL])),
        F.lit("Data types:"),
    ]
    body = [F.format_string("  - %s: %s (missing: %d)", F.lit(c.name), F.lit(c.dtype),
                            F.col(f"miss_{c.ordinal}")) for c in info]
    return rows_from_structs(one, [
        F.struct(F.lit(i + 1).cast("bigint").alias("line_no"), t.alias("text"))
        for i, t in enumerate(head + body)])


def rich_schema(df: DataFrame, max_cols: int = 10) -> DataFrame:
    """SC3b: the prompt block listing the first ``max_cols`` columns.

    The reference always prints "Unknown" rows (its schema dict has no shape
    key); this reports the true row count.
    """
    names = [c.name for c in columns_info(df)]
    shown = names[:max_cols] + ([f"... and {len(names) - max_cols} more"]
                                if len(names) > max_cols else [])
    one = df.agg(F.count(F.lit(1)).alias("rows"))
    text = F.format_string(
        "\nDATASET DETAILS:\n\nColumns: %s\n\nTotal Rows: %d\nTotal Columns: %d\n\n"
        "IMPORTANT RULES:\n- Always use ONLY these column names\n"
        "- Do NOT assume dataset structure\n- Match user query words with column names\n",
        F.lit(", ".join(shown)), F.col("rows"), F.lit(len(names)))
    return one.select(text.alias("text"))


def summary_counters(df: DataFrame) -> DataFrame:
    """SC5: one row with rows, columns, duplicate rows and missing cells."""
    info = columns_info(df)
    one = table_counts(df)
    total = sum((F.col(f"miss_{c.ordinal}") for c in info[1:]), F.col(f"miss_{info[0].ordinal}"))
    return one.select(F.col("rows").alias("n_rows"),
                      F.lit(len(info)).cast("bigint").alias("n_columns"),
                      F.col("dups").alias("duplicate_rows"),
                      total.cast("bigint").alias("missing_cells"))


def describe_numeric(df: DataFrame) -> DataFrame:
    """SC6: the sidebar describe, 3 decimals."""
    return describe_statistics(df, digits=3)


def dataset_intelligence(df: DataFrame) -> DataFrame:
    """SC4: per column dtype, class, missing, missing % (2 dp), describe(all)
    statistics, plus rows, columns and duplicate rows."""
    info = columns_info(df)
    one = table_counts(df)
    base = rows_from_structs(one, [
        F.struct(F.lit(c.ordinal).cast("bigint").alias("ordinal"), F.lit(c.name).alias("column"),
                 F.lit(c.dtype).alias("dtype"), F.lit(c.cls).alias("class"),
                 F.col(f"miss_{c.ordinal}").alias("missing"),
                 pct(F.col(f"miss_{c.ordinal}"), F.col("rows"), 2).alias("missing_pct"),
                 F.col("rows").alias("n_rows"),
                 F.lit(len(info)).cast("bigint").alias("n_columns"),
                 F.col("dups").alias("duplicate_rows"))
        for c in info])
    desc = describe_all(df).drop("column")
    return base.join(desc, "ordinal", "left")
