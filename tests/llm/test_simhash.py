import random
import re

import numpy as np
import pytest
import xxhash

from tabsmith.llm import simhash as sh

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(fps):
    """The smallest fingerprint that each one reaches."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    fps = sorted(fps)
    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3):
            x, y = find(f), find(fps[i + 1 + int(j)])
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def plain(rows):
    made = [(d, plain_fingerprint(t)) for d, t in rows]
    root = plain_roots({f for _, f in made})
    least = {}
    for d, f in made:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in made), key=repr)


def test_query_matches_plain_python(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in sh.op12_simhash_dedup(spark, SF).collect()), key=repr) == plain(rows)


def test_edges(spark):
    base = " ".join(f"Word{i % 90}" for i in range(400))
    texts = [None, "", " \t\x0b ", "one", "ONE", "two words", "a b c", "Ä b c", "ä b c", "a\x1cb c d", base, base.upper(),
             base + " tail", "tail " + base, "x" * 300_000, " ".join(["y"] * 50_000), "a b c", ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "other text of id three"), (None, base), (None, "alone here"), (3, "one")]
    df = spark.createDataFrame([(d, t, 1, "a", 2) for d, t in rows], "doc_id long, text string, fp int, component_id string, n int")
    assert sorted((tuple(r) for r in sh.simhash_dedup(df).collect()), key=repr) == plain(rows)
    assert sh.simhash_dedup(df.where("false")).collect() == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"w{i * 7919 % 1013}" for i in range(3000))
    whole = sh.fingerprint(text.encode())
    assert whole == plain_fingerprint(text)
    pieces = sh.word_pieces
    monkeypatch.setattr(sh, "word_pieces", lambda raw: pieces(raw, 7))
    monkeypatch.setattr(sh, "CHUNK", 5)
    assert sh.fingerprint(text.encode()) == whole
    assert sh.fingerprint(b"one two") == plain_fingerprint("one two")


def families(rng, spread):
    """Fingerprints around centres; some share a whole half, so variants have many members."""
    out = {0, 1, 7, 15}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randrange(spread)):
                f ^= 1 << b
            out.add(f)
    half = rng.getrandbits(32)
    out |= {half | rng.getrandbits(32) << 32 for _ in range(300)} | {half << 32 | rng.getrandbits(6) for _ in range(40)}
    return out


@pytest.mark.parametrize("group", [1024, 8, 2])
def test_every_link_is_found(spark, monkeypatch, group):
    monkeypatch.setattr(sh, "GROUP", group)         # small groups go through all three levels
    fps = families(random.Random(group), 7)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in sh.links(df).collect()]
    assert all(u != v and (u ^ v).bit_count() <= 3 for u, v in edges)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        x, y = find(u), find(v)
        root[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == plain_roots(fps)


def test_variants():
    v = sh._without(np.array([0b1011], np.uint64), 4)[0]
    assert v.tolist() == [0b101, 0b101, 0b111, 0b011]
    rng = random.Random(1)
    for _ in range(200):
        f, path = rng.getrandbits(64), 0
        for level in (1, 2, 3):
            at, paths, values = sh.signatures(level, np.array([f], np.uint64), np.array([path], np.uint64))
            assert len(paths) == len(set(zip(paths.tolist(), values.tolist()))) == {1: 64, 2: 32, 3: 16}[level]
            k = rng.randrange(len(paths))
            place, first = sh._deleted(paths[k:k + 1], level)
            g = f ^ 1 << int(place[0])              # differs in the deleted bit alone: the same variant
            _, p2, v2 = sh.signatures(level, np.array([g], np.uint64), np.array([path], np.uint64))
            assert (p2[k], v2[k]) == (paths[k], values[k])
            path = int(paths[k])
