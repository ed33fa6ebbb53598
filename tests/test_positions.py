"""Positions inside groups: exact for any keys, and no block takes a hot stretch."""

import random

import pytest
from pyspark.sql import functions as F

from tabsmith.functions import positions as pos

BIG = (1 << 63) - 1


def _check(spark, rows):
    df = spark.createDataFrame(rows, "g string, k long")
    got = {(r["g"], r["k"]): (r["p"], r["n"]) for r in pos.positions(df, ["g"], "k", "p", "n").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        keys = sorted(k for h, k in rows if h == g)
        want.update({(g, k): (i, len(keys)) for i, k in enumerate(keys, start=1)})
    assert got == want


@pytest.mark.parametrize("keys", [
    range(1000), [-BIG - 1, BIG, 0, 1, -1], [*range(500), BIG], [-BIG - 1, *range(10**17, 10**17 + 500)],
    [i * i * i for i in range(-300, 300)], [7]])
def test_positions_of_any_keys(spark, keys):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), k) for k in keys]
    _check(spark, rows)


def test_far_off_key_does_not_fill_a_block(spark):
    n = 100_000
    df = spark.range(n).select(F.when(F.col("id") == 0, F.lit(BIG)).otherwise(F.col("id")).alias("k"))
    lo, hi, q = df.agg(F.min("k"), F.max("k"), F.percentile_approx(
        "k", [i / pos.RANGES for i in range(1, pos.RANGES)], pos.ACCURACY)).first()
    blocks = df.groupBy(pos.block_of(F.col("k"), pos.range_cuts(lo, hi, q)).alias("b")).count()
    most, mean = blocks.agg(F.max("count"), F.avg("count")).first()
    # the last range reaches from the last quantile to the far-off key
    assert most <= n / pos.RANGES * 1.2 and mean < 3


def test_blocks_keep_the_order_of_keys(spark):
    rng = random.Random(9)
    keys = sorted({rng.randint(-BIG, BIG) for _ in range(2000)} | {2**62 - 1, 2**62, 2**62 + 1, -2**62})
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    cuts = pos.range_cuts(keys[0], keys[-1], keys[::100])
    got = [r["b"] for r in df.select("k", pos.block_of(F.col("k"), cuts).alias("b")).orderBy("k").collect()]
    assert got == sorted(got)


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([], "g string, k long")
    assert pos.positions(df, ["g"], "k", "p", "n").columns == ["g", "k", "p", "n"]
    some = spark.createDataFrame([("a", None), ("a", 4)], "g string, k long")
    assert [(r["k"], r["p"]) for r in pos.positions(some, ["g"], "k", "p").collect()] == [(4, 1)]
