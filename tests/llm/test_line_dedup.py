import hashlib

import numpy as np
import pytest

from tabsmith.llm.line_dedup import LineIndex, ShardIndex, line_dedup

WS = " \t\n\x0b\x0c\r"
LONG = "a line that is certainly longer than forty code points"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=5):
    keys = {}
    split = [(d, (t or "").split("\n")) for d, t in rows]
    for d, lines in split:
        for line in lines:
            k = line.strip(WS).translate(AZ)
            if len(k) >= 40:
                keys.setdefault(k, set()).add(d)
    out = []
    for d, lines in split:
        kept = [x for x in lines if not (len(s := keys.get(x.strip(WS).translate(AZ), ())) >= min_docs and max(s) != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def fixture():
    rows = [(i, f"{' ' * (i % 3)}{LONG if i % 2 else LONG.upper()}\t\nown line {i}\n{LONG}") for i in range(12)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "É" * 39), (24, "É" * 40), (25, "é" * 40)]
    rows += [(30 + i, "É" * 40 + "\n" + "x" * 39) for i in range(6)] + [(50, "w" * 300_000)]
    rows += [(i, f"{LONG} shared by few") for i in range(60, 64)]
    return rows + [(3, rows[3][1]), (99, f"{LONG} repeated row\n{LONG} repeated row")] * 3


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_equals_brute_force(spark, limit):
    rows = fixture()
    df = spark.createDataFrame([(d, t, d * 2, "s") for d, t in rows], "doc_id long, text string, n_lines long, shard string")
    got = line_dedup(df, broadcast_bytes=limit)
    assert got.columns == ["doc_id", "text", "_n_lines", "shard", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_empty_table_and_null_ids(spark, limit):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string"), broadcast_bytes=limit).collect() == []
    rows = [(None, LONG)] + [(i, LONG) for i in range(5)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=limit).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {None: 1, 0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 1000, 70_001):
        h = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        n = len(h)
        index = ShardIndex.build(h, h.view(np.int64), np.arange(n, dtype=np.int32), np.arange(n))
        again = ShardIndex.from_bytes(index.to_bytes())
        place = again.places(h)
        assert sorted(place.tolist()) == list(range(n))
        assert (again.fingerprint[place] == h.view(np.int64)).all()
        other = rng.integers(0, 2**63, 500, dtype=np.uint64)
        assert (again.probe(other.view(np.int64), other.view(np.int64) + 1) == -1).all()


def test_keys_with_equal_first_halves_are_both_found():
    over = np.array([[7, 2, 42]], "<i8").tobytes()
    one = ShardIndex.build(np.array([7], np.uint64), np.array([1]), np.array([5], np.int32), np.array([41]))
    index = LineIndex([(0, one.to_bytes(), over)], 1)
    found, keeper = index.keepers(np.array([[7, 1], [7, 2], [7, 3]]))
    assert found.tolist() == [True, True, False] and keeper.tolist() == [41, 42, 0]


def test_query_digest(spark):
    from tabsmith.llm.line_dedup import op9_line_dedup
    rows = op9_line_dedup(spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs)]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows) == want
