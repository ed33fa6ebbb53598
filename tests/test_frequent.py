"""Top values and modes without moving texts, against plain Python counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsmith.functions import frequent as fr
from tabsmith.operators import clean, profile


def plain(values, k):
    c = Counter(v for v in values if v is not None)
    return sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:k], len(c)


def check(spark, values, k=5):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    got = sorted((r["rank"], r["value"], r["count"], r["nunique"]) for r in profile.top_values(df, k).collect())
    top, distinct = plain(values, k)
    assert got == [(i + 1, v, n, distinct) for i, (v, n) in enumerate(top)]
    assert fr.modes(df, ["t"]) == ({"t": top[0][0]} if top else {})


def words(rng, n):
    return [rng.choice(["", "a", "b" * 31, "b" * 32, "b" * 33, "b" * 33 + "x", "ü" * 20, "long " * 50, "long " * 50 + "z"]) for _ in range(n)]


def test_ties_and_long_values(spark):
    rng = random.Random(1)
    check(spark, words(rng, 60) + [None] * 100)
    check(spark, [None, None])
    check(spark, ["b" * 40 + c for c in "zyxwvut"] * 2 + ["b" * 16, "b" * 15])         # one head, one count
    check(spark, ["x"] * 3 + ["y"] * 3 + [None])


@pytest.mark.parametrize("fetch", [10_000, 3])
def test_all_values_distinct(spark, monkeypatch, fetch):
    monkeypatch.setattr(fr, "FETCH", fetch)         # few enough ties to grow the heads
    rng = random.Random(2)
    check(spark, [f"{rng.randrange(10**9)}" for _ in range(300)])
    same = "the same beginning of every text, " * 30
    check(spark, [same + f"{rng.randrange(10**9)}" for _ in range(200)] + [same, same[:16], same[:32], same[:33]])


def test_keys_tell_values_apart(spark):
    rng = random.Random(3)
    values = {"".join(rng.choice("ab") for _ in range(rng.randrange(30, 36))) for _ in range(400)} | {"", "ä" * 16, "ä" * 17}
    df = spark.createDataFrame([(v,) for v in values], "t string")
    keys = [bytes(r["k"]) for r in df.select(fr.key_of(F.col("t")).alias("k")).collect()]
    assert len(set(keys)) == len(values) and max(map(len, keys)) == fr.KEY_BYTES + 1


def test_a_key_is_no_longer_for_longer_texts(spark):
    sizes = []
    for length in (200, 20_000):
        df = spark.createDataFrame([(f"{i % 50}-" + "x" * length,) for i in range(500)], "t string")
        counts = fr.key_counts(df, ["t"])
        sizes.append(counts.agg(F.sum(F.octet_length("key"))).first()[0])
        assert "value" not in counts.columns
    assert sizes[0] == sizes[1]


def test_proof_of_the_sketch():
    assert fr.proven_modes(0, [(1, 5), (2, 5), (3, 4)]) == [1, 2]
    assert fr.proven_modes(10, [(1, 100), (None, 500), (2, 91), (3, 89)]) == [1, 2]
    assert fr.proven_modes(10, [(1, 30)]) is None                  # an unlisted value may have as many
    assert fr.proven_modes(0, []) is None and fr.proven_modes(0, [(None, 9)]) is None
    full = [(i, 100) for i in range(fr.CANDIDATES)]
    assert fr.proven_modes(1, full) is None and fr.proven_modes(1, full[:-1] + [(99, 50)]) is not None


def test_modes_use_the_sketch_and_agree(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), f"{rng.randrange(10**8)}", "hot" if rng.random() < .4 else f"{rng.randrange(10**6)}", None) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "few string, all string, hot string, none string")
    names = df.columns
    want = {n: plain([r[i] for r in rows], 1)[0][0][0] for i, n in enumerate(names[:3])}
    counted = []
    count = fr.key_counts
    monkeypatch.setattr(fr, "key_counts", lambda d, n: counted.append(n) or count(d, n))
    assert clean.column_modes(df, names) == want
    assert counted == [["all", "none"]]             # the sketch proves the others
