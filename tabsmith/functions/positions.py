"""Row positions inside groups without a window over a whole group.

``row_number().over(partitionBy(g).orderBy(k))`` sorts each group in one
task; a group holding a third of the rows becomes one straggler task. For an
integral key that is unique inside each group, the position can be built from
bounded pieces instead:

1. the key range is cut at sampled quantiles into ``RANGES`` ranges of about as
   many rows, and each range into ``PARTS`` blocks of equal width: far-off keys
   or a dense stretch take ranges of their own instead of filling one block;
2. rows per (group, bucket), pre-aggregated, and a running count per group
   (a window over at most ``RANGES * PARTS`` rows) give each bucket's offset;
3. position = offset + row_number inside (group, bucket).

The quantiles only place the cuts; positions are exact whatever they are.

The join of the rows with the bucket offsets is on (group, bucket), a key that
is never hot, and both sides arrive partitioned by it, so the last window
needs no further shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.columns import col

RANGES = 256
PARTS = 256
ACCURACY = 10_000       # of the sampled quantiles: a range is within 1/10000 of its share of rows
FIXED_CUTS = (-(1 << 62), 0, 1 << 62)       # no range is wider than a long can measure


def range_cuts(lo: int, hi: int, sampled: list[int], parts: int | None = None) -> list[tuple[int, int]]:
    """(first key, block width) of each range, in order, from sampled quantiles; ``parts`` (PARTS) blocks a range."""
    firsts = sorted({lo, *(int(q) for q in sampled if lo < q <= hi), *(c for c in FIXED_CUTS if lo < c <= hi)})
    ends = firsts[1:] + [hi + 1]
    return [(a, max(1, math.ceil((b - a) / (parts or PARTS)))) for a, b in zip(firsts, ends)]


def block_of(key: Column, cuts: list[tuple[int, int]], parts: int | None = None) -> Column:
    """The number of the block that holds ``key``: a binary search among the
    ranges' first keys, then the place inside the range."""
    firsts = F.array(*[F.lit(a).cast("bigint") for a, _ in cuts])
    widths = F.array(*[F.lit(w).cast("bigint") for _, w in cuts])
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    at = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda pos, step: F.when(
        (pos + step <= len(cuts)) & (F.element_at(firsts, F.least(pos + step, F.lit(len(cuts)))) <= key),
        pos + step).otherwise(pos))
    found = F.greatest(at, F.lit(1))
    inside = F.floor((key - F.element_at(firsts, found)) / F.element_at(widths, found))
    # division of longs is in doubles: a rounded place stays inside the range and in order
    return F.when(key.isNotNull(), found.cast("bigint") * ((parts or PARTS) + 1) + F.least(inside, F.lit(parts or PARTS)))


def key_blocks(df: DataFrame, key: str) -> DataFrame | None:
    """The rows that have a ``key`` with its block as ``_pb`` (steps 1 and 2); None when no row has one."""
    k = col(key).cast("bigint")
    shares = [i / RANGES for i in range(1, RANGES)]
    lo, hi, sampled = df.agg(F.min(k), F.max(k), F.percentile_approx(k, shares, ACCURACY)).collect()[0]
    if lo is None:
        return None
    tagged = df.withColumn("_pb", block_of(k, range_cuts(int(lo), int(hi), sampled)))
    return tagged.filter(F.col("_pb").isNotNull())


def positions(df: DataFrame, groups: list[str], key: str, out: str = "pos",
              total: str | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row in its group ordered by the
    integral ``key`` (unique within the group; a row without one is left out); ``total`` optionally adds the
    group size."""
    tagged = key_blocks(df, key)
    if tagged is None:
        res = df.withColumn(out, F.lit(None).cast("bigint"))
        return res.withColumn(total, F.lit(None).cast("bigint")) if total else res
    counts = tagged.groupBy(*groups, "_pb").agg(F.count(F.lit(1)).alias("_pn"))
    run = Window.partitionBy(*groups).orderBy("_pb")
    offs = counts.withColumn(
        "_po", F.coalesce(F.sum("_pn").over(run.rowsBetween(Window.unboundedPreceding, -1)),
                          F.lit(0)))
    if total:
        offs = offs.withColumn(total, F.sum("_pn").over(Window.partitionBy(*groups)).cast("bigint"))
    keep = [*groups, "_pb", "_po"] + ([total] if total else [])
    joined = tagged.join(offs.select(*keep), [*groups, "_pb"])
    inner = Window.partitionBy(*groups, "_pb").orderBy(col(key))
    return (joined.withColumn(out, (F.col("_po") + F.row_number().over(inner)).cast("bigint"))
                  .drop("_pb", "_po"))
