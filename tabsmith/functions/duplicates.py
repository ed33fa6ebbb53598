"""Exact duplicate detection that shuffles row hashes, not rows.

``count(DISTINCT struct(*))`` and ``dropDuplicates()`` shuffle every
distinct row in full. When duplicates are rare (the usual case) almost all of
that traffic only proves uniqueness. Here:

1. one scan computes a 64-bit hash of each row (``-0.0`` normalised to
   ``0.0`` so that equal rows hash equally) and ``groupBy(hash).count()``
   with map-side partial aggregation -- 16 bytes per row cross the network,
   however many columns there are (missing counts are a separate one-row
   aggregate); row totals come from the same aggregation and job;
2. rows whose hash occurs once are unique for certain; only rows whose hash
   repeats (true duplicates plus rare 64-bit collisions) are candidates; their
   hashes are materialised (small), semi-joined back (broadcast only below a
   checked size) and de-duplicated exactly.

Identical rows always share a hash, so the result is exact. A hot duplicate
row collapses in the partial aggregation of step 1 and of step 2's distinct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.columns import FLOAT_TYPES, col
from tabsmith.session import materialize

HASH = "__row_hash"
BROADCAST_HASHES = 5_000_000


def _has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.ArrayType):
        return _has_map(dt.elementType)
    return isinstance(dt, T.StructType) and any(_has_map(f.dataType) for f in dt.fields)


def comparable(c: Column, dt: T.DataType) -> Column:
    """``c`` in a form whose equality is the value's: maps (also nested ones) as
    sorted arrays of entries, ``-0.0`` as ``0.0``."""
    if isinstance(dt, FLOAT_TYPES):
        return F.when(c == 0, F.lit(0.0).cast(dt)).otherwise(c)
    if isinstance(dt, T.MapType):
        entry = lambda e: F.struct(comparable(e["key"], dt.keyType).alias("key"),
                                   comparable(e["value"], dt.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(c), entry))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: comparable(e, dt.elementType))
    if isinstance(dt, T.StructType):
        made = F.struct(*[comparable(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields])
        return F.when(c.isNotNull(), made)
    return c


def key_exprs(df: DataFrame) -> list[Column]:
    """What identifies a row: its columns, those that hold maps in comparable form."""
    return [(comparable(col(f.name), f.dataType) if _has_map(f.dataType) else col(f.name)).alias(f"__k{i}")
            for i, f in enumerate(df.schema.fields)]


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df`` with each row once, whatever its column types."""
    if not any(_has_map(f.dataType) for f in df.schema.fields):
        return df.dropDuplicates()
    keys = [f"__k{i}" for i in range(len(df.columns))]
    return df.select(*[col(c) for c in df.columns], *key_exprs(df)).dropDuplicates(keys).drop(*keys)


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[comparable(col(f.name), f.dataType) for f in df.schema.fields])


@dataclass
class DuplicateStats:
    rows: int
    distinct: int
    candidates: DataFrame | None       # materialised hashes that repeat (None: no duplicates)
    n_candidate_hashes: int

    @property
    def duplicates(self) -> int:
        return self.rows - self.distinct


def duplicate_stats(df: DataFrame) -> DuplicateStats:
    """Rows and distinct rows of the input.

    One job scans the input once: ``groupBy(hash)`` feeds both the repeated
    hashes and a one-row totals branch; the two branches share the exchange,
    and both land in one small materialised table. Only the hash and its count
    travel, however many columns there are. Only when some hash repeats does a
    second job read the candidate rows (distinct = rows - candidate rows +
    distinct candidates). No ``observe``: an observed session can no longer
    serialise Spark ML models (their training summary references the session).
    """
    grouped = df.select(row_hash(df).alias(HASH)).groupBy(HASH).agg(F.count(F.lit(1)).alias("__n"))
    cand_part = grouped.filter(F.col("__n") > 1).select(
        F.lit(0).alias("__kind"), HASH, F.col("__n").cast("long").alias("__rows"))
    total_part = grouped.agg(
        F.lit(1).alias("__kind"), F.count_if(F.col("__n") > 1).cast("long").alias(HASH),
        F.sum("__n").cast("long").alias("__rows"))
    both = materialize(cand_part.unionByName(total_part))
    tot = both.filter(F.col("__kind") == 1).first()
    rows = int(tot["__rows"] or 0)
    n_hashes = int(tot[HASH] or 0)      # the totals row carries the candidate count
    cand = both.filter(F.col("__kind") == 0).select(HASH)
    if n_hashes == 0:
        return DuplicateStats(rows, rows, None, 0)
    keys = key_exprs(df)
    if n_hashes > BROADCAST_HASHES:
        # many duplicates: a shuffle semi-join would move every row anyway,
        # so one direct distinct (partial aggregation first) is cheaper
        return DuplicateStats(rows, df.select(*keys).distinct().count(), cand, n_hashes)
    per_row = (candidate_rows(df, cand, n_hashes).select(*keys).groupBy(*[f"__k{i}" for i in range(len(keys))])
               .agg(F.count(F.lit(1)).alias("__c")))
    got = per_row.agg(F.sum("__c").alias("rows"), F.count(F.lit(1)).alias("distinct")).first()
    distinct = rows - int(got["rows"] or 0) + int(got["distinct"] or 0)
    return DuplicateStats(rows, distinct, cand, n_hashes)


def candidate_rows(df: DataFrame, cand: DataFrame, n_hashes: int, keep: str = "left_semi"):
    """Rows whose hash is (``left_semi``) or is not (``left_anti``) among the
    candidate hashes; the hash set is broadcast only below a checked size."""
    side = F.broadcast(cand) if n_hashes <= BROADCAST_HASHES else cand
    return df.withColumn(HASH, row_hash(df)).join(side, HASH, keep).drop(HASH)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact ``dropDuplicates`` where only rows with a repeated hash shuffle:
    unique-hash rows pass through (anti join), candidates are de-duplicated."""
    st = duplicate_stats(df)
    if st.candidates is None:
        return df
    if st.n_candidate_hashes > BROADCAST_HASHES:
        return distinct_rows(df)
    unique = candidate_rows(df, st.candidates, st.n_candidate_hashes, "left_anti")
    dups = candidate_rows(df, st.candidates, st.n_candidate_hashes, "left_semi")
    return unique.unionByName(distinct_rows(dups))
