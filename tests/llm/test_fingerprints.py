import hashlib
import random

from pyspark.sql import functions as F

from tabsmith.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"


def sketches(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r.sketch for r in fp.fingerprint(df).orderBy("i").collect()]


def test_equal_texts_and_edges(spark):
    a = "One two three four five six seven eight nine ten " * 3
    got = sketches(spark, [None, "", " \n\t", "Two words", "two   WORDS", a, a.upper(), "x" * 100_000, "two  words more"])
    assert got[:3] == [[], [], []]
    assert got[3] == got[4] and len(got[3]) == 1 and got[3] != got[8]
    assert got[5] == got[6] and got[5] == sorted(set(got[5]))
    assert len(got[7]) == 1


def test_sketch_is_a_share_of_shingles_and_merges(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(16_004)]
    small, large = " ".join(words[2000:6004]), " ".join(words)
    s, l = sketches(spark, [small, large])
    assert 16_000 / fp.FRACTION * 0.85 < len(l) < 16_000 / fp.FRACTION * 1.15
    assert set(s) <= set(l) and all(h < fp.LIMIT for h in l)        # contained in a much larger text
    row = spark.createDataFrame([(s, l, [fp.LIMIT + 5], [])], "s array<long>, l array<long>, a array<long>, e array<long>").select(
        fp.containment(F.col("s"), F.col("l")).alias("c"), fp.likeness(F.col("s"), F.col("l")).alias("k"),
        fp.merge(F.col("s"), F.col("l")).alias("m"), fp.merge(F.col("a"), F.col("e")).alias("one"),
        fp.merge(F.col("a"), F.col("s")).alias("drop"), fp.likeness(F.col("e"), F.col("e")).alias("same"),
        fp.likeness(F.col("e"), F.col("s")).alias("none")).first()
    assert row.c == 1.0 and abs(row.k - 0.25) < 0.05 and row.m == l
    assert row.one == [fp.LIMIT + 5] and row.drop == s and row.same == 1.0 and row.none == 0.0


def test_short_texts_inside_long_ones(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        rows.append((" ".join(words[100:115]), " ".join(words)))        # 11 shingles of 596
    df = spark.createDataFrame(rows, "short string, long string")
    df = fp.fingerprint(fp.fingerprint(df, text_col="short", name="s"), text_col="long", name="l")
    got = [r.c for r in df.select(fp.containment(F.col("s"), F.col("l")).alias("c")).collect()]
    assert set(got) <= {1.0, None} and got.count(None) < 0.1 * len(got)


def brute_edit(rows):
    out = {}
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        out[d] = t[:len(t) - n] + nxt[:n]
    return out


def test_query_against_plain_python(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = brute_edit(docs)
    texts = dict(docs)
    got = fp.op10_fingerprints(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    order = sorted(got, key=lambda r: r.doc_id)
    parse = lambda s: {s[i:i + 16] for i in range(0, len(s), 16)}
    for k, r in enumerate(order):
        a, b, c = parse(r.fingerprint), parse(r.edited_fingerprint), parse(order[(k + 1) % len(order)].fingerprint)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 1e-12
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1)) < 1e-12
    long = [r for r in got if r.n_chars > 4000]
    assert sum(r.near_edited for r in long) / len(long) > 0.5 > 0.1 > sum(r.near_next for r in long) / len(long)


def test_next_over_many_blocks_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 3)
    rows = [(i * i, f"t{i}") for i in range(40)] + [(None, "n"), (16, "t4"), (16, "t4b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fp.with_next(df, "doc_id", "text", {}).collect()
    assert len(got) == len(rows)
    follow = {}
    for r in got:
        follow.setdefault((r.id, r.text), []).append(r.next.text)
    assert follow[(1521, "t39")] == ["n"] and follow[(None, "n")] == ["t0"]
    for i in range(39):
        if i not in (3, 4):
            assert follow[(i * i, f"t{i}")] == [f"t{i + 1}"]
    ring = follow[(9, "t3")] + follow[(16, "t4")] + follow[(16, "t4b")]
    assert sorted(ring) == ["t4", "t4", "t4b", "t5"]
    assert fp.with_next(df.limit(0), "doc_id", "text", {}).collect() == []
    one = fp.with_next(spark.createDataFrame([(5, "x")], "doc_id long, text string"), "doc_id", "text", {}).collect()
    assert one[0].next.text == "x"


def ring_of(rows):
    """The texts in the order of (id, hash), null ids first: rows of (id, text, hash)."""
    return [t for _, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]


def test_far_off_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 8)
    rows = ([(i, f"t{i}") for i in range(300)] + [(1 << 61, "far"), (-(1 << 62), "low")] + [(40, f"same {i}") for i in range(200)]
            + [(None, f"none {i}") for i in range(200)])
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    keyed = df.withColumn("key", F.xxhash64("text"))
    sizes = [r["count"] for r in keyed.withColumn("block", fp._blocks(keyed)).groupBy("block").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 40       # blocks of 8 rows on average, one id's 200 rows cut by key
    texts = ring_of([(r.id, r.text, r.key) for r in keyed.collect()])
    got = {r.text: r.next.text for r in fp.with_next(df, "id", "text", {}).collect()}
    assert got == {t: texts[(k + 1) % len(texts)] for k, t in enumerate(texts)}


def test_all_ids_missing(spark):
    df = spark.createDataFrame([(None, f"x{i}") for i in range(30)], "id long, text string")
    got = {r.text: r.next.text for r in fp.with_next(df, "id", "text", {}).collect()}
    assert sorted(got.values()) == sorted(got) and len(got) == 30


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([("a b", 1, 2)], "text string, sketch int, key int")
    assert fp.fingerprint(df).columns == ["text", "_sketch", "key", "sketch"]


def test_no_python_in_the_plan(spark, capsys):
    fp.op10_fingerprints(spark, SF).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
