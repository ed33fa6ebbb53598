import random
import re

import numpy as np
import pytest

from tabsmith.llm import ngram_join as nj
from tabsmith.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (di, a) in enumerate(sets):
        for j, (dj, b) in enumerate(sets[:i]):
            if a and b and di is not None and dj is not None and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least[find(i)] if d is not None else None) for i, (d, s) in enumerate(sets)), key=repr)


def fixture():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    text = lambda n: [word() for _ in range(n)]
    passage = text(60)
    rows = []

    def edit(w, k):
        w = list(w)
        for i in rng.sample(range(len(w)), k):
            w[i] = word()
        return w
    base = text(200)
    rows += [" ".join(edit(base, rng.randrange(0, 9))) for _ in range(70)]         # a large group near the threshold
    rows += [" ".join(text(40) + passage + text(40)) for _ in range(60)]           # a shared passage, no links
    rows += [" ".join(passage)] * 3 + [" ".join(edit(passage, 1)), " ".join(passage + text(14)), " ".join(passage + text(30))]
    chain = text(100)
    for k in range(10):                                                            # a chain: neighbours link, ends don't
        rows.append(" ".join(chain[6 * k:] + text(6 * k)))
    rows += ["one two", "One  TWO", "one two three", "", None, " \n ", "x " * 30_000, "x " * 20, "a b c d e", "A b c d E"]
    rows += [base_text.upper() for base_text in rows[:3]]
    return list(enumerate(rows)) + [(0, rows[0]), (5, "other text of a repeated id here"), (None, rows[0]), (None, rows[0])]


@pytest.fixture
def joined(spark):
    rows = fixture()
    df = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, node int, token string").repartition(7)
    return rows, df


def result(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_join(df, **kw).collect()), key=repr)


def test_components_equal_brute_force(joined):
    rows, df = joined
    assert result(df) == brute(rows)


def test_small_limits_lose_nothing(joined, monkeypatch):
    """Large groups, many trees and the join of ids by a shuffle give the same components."""
    rows, df = joined
    monkeypatch.setattr(nj, "SMALL_GROUP", 3)
    monkeypatch.setattr(nj, "TREE_SETS", 4)
    monkeypatch.setattr(nj, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(nj, "FREQUENT", 8)
    assert result(df) == brute(rows)


def test_empty_table(spark):
    assert nj.ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefix_tree_equals_plain_intersections():
    rng = np.random.default_rng(4)
    base = rng.choice(10_000, 300, replace=False).astype(np.uint64)
    order = nj.Order(np.sort(base)[::3])
    sets = []
    for k in range(120):
        keep = rng.random(300) > rng.random() * 0.4
        extra = rng.choice(90_000, rng.integers(0, 90)).astype(np.uint64) + np.uint64(20_000)
        sets.append((k, np.unique(np.concatenate([base[keep], extra]))))
    tree = nj.PrefixTree([(k, np.ascontiguousarray(order.sort(s)[::-1])) for k, s in sets])
    for k, probe in sets[:40]:
        want = {j for j, s in sets if 100 * len(np.intersect1d(s, probe)) >= 75 * len(np.union1d(s, probe))}
        assert set(tree.linked(probe, 75, 100, 16)) == want


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(7, 7)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(1, 0)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, m = rng.integers(1, 700, 2)
        pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, k)) for k in (n, m))
        true = len(np.intersect1d(a, b))
        assert true <= nj.overlap_bound(nj.sketch(a), nj.sketch(b)) <= min(len(a), len(b))
    many = np.arange(64, dtype=np.uint64) << np.uint64(20)         # all in one bucket for long
    assert nj.overlap_bound(nj.sketch(many), nj.sketch(many)) == 64
