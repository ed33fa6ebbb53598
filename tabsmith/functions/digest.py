"""Digests of rows and frames that do not depend on the order of rows.

A row has two 64-bit hashes of differently begun chains over its cells, and of
which cells are missing (a hash of Spark's skips a null, so that ``(1, null)`` and
``(null, 1)`` would meet). Cells of arrays, structs and maps go in as JSON text with
their nulls, maps with sorted entries; ``-0.0`` counts as ``0.0``.

A frame's digest is the number of its rows and the sums of both hashes: a row that
repeats counts as often as it does, and the sums add up over parts of a frame. It is one
aggregate of one row, so rows are never shuffled. Two frames with other rows
have one digest with a chance of about 2^-128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.columns import col
from tabsmith.functions.duplicates import comparable

#: Hashes are summed in pieces of so many bits: 2^47 rows fit a long.
PIECE = 16
NESTED = (T.ArrayType, T.StructType, T.MapType)


def cell(df: DataFrame, name: str) -> Column:
    """A cell in a form that hashes apart from all others of its column."""
    dt = df.schema[name].dataType
    c = comparable(col(name), dt)
    if isinstance(dt, NESTED):
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        return F.when(col(name).isNotNull(), text)
    return c


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two independent hashes of a row."""
    cells = [cell(df, c) for c in df.columns]
    missing = F.concat(F.lit(""), *[F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return F.xxhash64(missing, *cells), F.xxhash64(F.lit("second"), missing, *cells)


def frame_digest(df: DataFrame) -> tuple[int, ...]:
    """The number of rows and the sums of their hashes' pieces: one pass, one row, no shuffle of rows."""
    hashed = df.select(*[h.alias(f"h{i}") for i, h in enumerate(row_hashes(df))])
    sums = [F.sum(F.shiftrightunsigned(f"h{i}", at).bitwiseAND((1 << PIECE) - 1)).alias(f"s{i}_{at}")
            for i in range(2) for at in range(0, 64, PIECE)]
    return tuple(v or 0 for v in hashed.agg(F.count(F.lit(1)).alias("rows"), *sums).first())
