"""Column classes, missing-value normalisation and small expression helpers.

All operators branch on two column classes, as pandas' ``select_dtypes`` does:

* numeric      - byte, short, int, long, float, double, decimal
* categorical  - string
* other        - boolean, date, timestamp, arrays, maps, structs, binary ...

A boolean column is neither numeric nor categorical (pandas leaves a complete
bool column out of both ``number`` and ``object``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

NUMERIC = "numeric"
CATEGORICAL = "categorical"
OTHER = "other"


@dataclass(frozen=True)
class ColumnInfo:
    ordinal: int
    name: str
    dtype: str
    cls: str


def column_class(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC_TYPES):
        return NUMERIC
    if isinstance(dt, T.StringType):
        return CATEGORICAL
    return OTHER


def columns_info(df: DataFrame) -> list[ColumnInfo]:
    """Driver-side schema inspection (no Spark job)."""
    return [ColumnInfo(i + 1, f.name, f.dataType.simpleString(), column_class(f.dataType))
            for i, f in enumerate(df.schema.fields)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [c.name for c in columns_info(df) if c.cls == NUMERIC]


def categorical_columns(df: DataFrame) -> list[str]:
    return [c.name for c in columns_info(df) if c.cls == CATEGORICAL]


def q(name: str) -> str:
    """Back-quote a column name for use inside SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL on float/double columns (decision D1), as one projection.

    Spark keeps NaN and NULL apart (``avg`` over NaN gives NaN, ``isNull``
    misses it); pandas treats both as missing. After this every operator only
    needs to test NULL.
    """
    if not any(isinstance(f.dataType, FLOAT_TYPES) for f in df.schema.fields):
        return df
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, FLOAT_TYPES):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).cast(f.dataType)
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def as_double(name: str) -> Column:
    return col(name).cast("double")


def round4(c: Column) -> Column:
    """Half-to-even rounding, the rounding pandas / numpy ``round`` use."""
    return F.bround(c.cast("double"), 4)


def round_doubles(df: DataFrame, digits: int = 4, per_column: dict | None = None) -> DataFrame:
    """Round every float/double column half-to-even (presentation of results);
    ``per_column`` overrides the number of digits by column name."""
    per_column = per_column or {}
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, FLOAT_TYPES):
            c = F.bround(c.cast("double"), per_column.get(f.name, digits))
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def pct(part: Column, whole: Column, digits: int) -> Column:
    """``round(100 * part / whole, digits)``; NULL when ``whole`` is 0."""
    return F.bround(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), digits)


def rows_from_structs(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row frame into several rows, one per struct (tidy unpivot)."""
    if not structs:
        raise ValueError("no rows to produce")
    return one_row.select(F.inline(F.array(*structs)))
