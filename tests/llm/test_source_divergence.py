import random
import re
from collections import Counter

import numpy as np

from tabsmith.llm import source_divergence as sd

SF = "/root/testdata/sf0.001"


def plain(rows, min_docs=10, top=10):
    """The contract, term by term."""
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+",
                                          "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for l, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        have = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in have.items() if n >= min_docs]

        def shares(words):
            n = Counter(words)
            total = sum(n[t] for t in kept)
            return n, {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        _, q = shares(w for d in mine for w in d[2])
        p = {s: shares([w for d in mine if d[1] == s for w in d[2]]) for s in {d[1] for d in mine}}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, (n, ps) in p.items():
            pairs = [(sum(f(ps[t], pt[t]) for t in kept), o) for o, (_, pt) in p.items() if o != s]
            terms = [(f(ps[t], q[t]), t) for t in kept if n[t] and ps[t] > q[t]]
            order = lambda x: (-x[0], x[1].encode())
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(sorted(pairs, key=order))]
            out += [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(sorted(terms, key=order)[:top])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(1, *r, "a", 5, 6) for r in rows],
                               "doc_id long, lang string, source string, text string, term string, n int, p int")
    return sorted(tuple(r) for r in sd.source_divergence(df, **kw).collect())


def test_query_matches_plain_python(spark):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in sd.op13_source_divergence(spark, SF).collect()) == plain(rows)


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "en", None, "", "fr"])
        source = rng.choice(["hot", "hot", "b", "c", None, "", "日本", "z\x00"])
        words = [rng.choice(["Alpha", "beta", "GAMMA", "çedille", "ÇEDILLE", "naïve", "x", "日本語"]) for _ in range(rng.randrange(30))]
        words += [f"rare{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(6))]
        rows.append((lang, source, rng.choice([" ", "-", "1", "\n"]).join(words)))
    rows += [("en", "silent", None), ("en", "digits", "1 2 3 !"), ("xx", "one", "few terms"), ("xx", "two", None), ("lone", "s", "a b")]
    rows += [("en", "long", "word " * 50_000 + "y" * 200_000)] * 2
    return rows


def test_edges(spark):
    rows = corpus()
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, min_docs=1, top_terms=3) == plain(rows, 1, 3)
    assert run(spark, rows * 3) == plain(rows * 3)                  # repeated rows
    assert run(spark, []) == []


def test_small_tables_and_slices(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(sd, "HELD_TERMS", 7)        # tasks hand counts on early
    monkeypatch.setattr(sd, "SLICE", 11)            # and cut the index into many slices
    assert run(spark, rows) == plain(rows)


def test_accumulate_counts_shared_terms_alone():
    term = np.array([1, 1, 2, 2, 2, 3])
    row = np.array([0, 1, 0, 1, 2, 2])
    p, z = np.array([50, 40, 30, 20, 10, 9]), np.array([5, 4, 5, 4, 3, 3])
    got = {(r, int(t)): int(v) for r, peers, sums in sd.accumulate(term, row, p, z, 3) for t, v in zip(peers, sums)}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    part = lambda i, j: f(p[i], p[j]) - f(p[i], z[j]) - f(z[i], p[j]) + f(z[i], z[j])
    assert got == {(0, 1): part(0, 1) + part(2, 3), (1, 0): part(1, 0) + part(3, 2), (0, 2): part(2, 4), (2, 0): part(4, 2),
                   (1, 2): part(3, 4), (2, 1): part(4, 3)}
