import hashlib
import math
import random

import pytest

from tabsmith.llm import centroids as ce

SF = "/root/testdata/sf0.001"


def plain(vectors, k, rounds, dims=64, scale=256):
    """The contract, on lists of (id, components)."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in vectors
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda p: (p[0] is None, hashlib.sha256(f"2:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1])
    middle = [list(x) for _, x in sorted(kept, key=key)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for c, xs in groups.items():
            middle[c] = [sum(col) // len(xs) for col in zip(*xs)]
    out, inertia = [], {}
    for i, x in kept:
        d, c = nearest(x)
        out.append((i, c, d))
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, dots int, cluster string, v int")
    return sorted((tuple(r)[:6] for r in ce.cluster_vectors(df, **kw).collect()), key=repr)


def test_query_matches_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = sorted((tuple(r) for r in ce.op11_centroid_clustering(spark, SF).collect()), key=repr)
    assert got == plain([(r.vec_id, r.embedding) for r in rows], 40, 5)


def test_edges(spark):
    rng = random.Random(4)
    half = lambda: [rng.randrange(-12, 12) / 8 for _ in range(64)]
    same = half()
    vectors = [(i, half()) for i in range(60)] + [(100 + i, same) for i in range(90)]       # repeated vectors, ties
    vectors += [(7, half()), (7, same), (None, half()), (None, same)]                       # repeated and null ids
    vectors += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65), (204, [None] + [0.0] * 63),
                (205, [float("nan")] + [0.0] * 63), (206, [float("inf")] + [0.0] * 63), (207, [-0.001] * 64)]
    rows = [(i, v, "a", 1, "b", 2) for i, v in vectors]
    assert run(spark, rows, k=5, rounds=3) == plain(vectors, 5, 3)
    assert run(spark, rows, k=40, rounds=5) == plain(vectors, 40, 5)        # equal starts: empty centroids stay
    assert run(spark, rows[:3], k=40, rounds=2) == plain(vectors[:3], 40, 2)
    assert run(spark, rows, k=4, rounds=0) == plain(vectors, 4, 0)


def test_empty_and_refused(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, "a", 1, "b", 2)]) == []
    with pytest.raises(ValueError):
        run(spark, [(1, [3e38] + [0.0] * 63, "a", 1, "b", 2)])


def test_large_components_stay_exact(spark):
    top = 524_287.0
    vectors = [(1, [top] * 64), (2, [-top] * 64), (3, [top - 0.25] * 64)]
    got = run(spark, [(i, v, "a", 1, "b", 2) for i, v in vectors], k=2, rounds=1)
    assert got == plain(vectors, 2, 1)
