import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabsmith.llm import lm_scoring as lm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Plain:
    """The same model in plain Python, from the definition."""

    def __init__(self, texts, order=lm.ORDER):
        self.c = Counter(w for t in texts for w in words(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        least = lm.LEAST
        kept = {w for w, n in self.c.items() if n >= least} | {"</s>", "<s>"}
        self.context = Counter(self.c)
        self.context["<s>"] = len(texts)
        self.grams = [{(w,) for w in kept}]
        self.counts = Counter()
        for k in range(2, order + 1):
            found = Counter()
            for t in texts:
                w = ["<s>", *words(t)]
                for i in range(len(w) - k + 1):
                    g = tuple(w[i:i + k])
                    if g[:-1] in self.grams[-1] and g[1:] in self.grams[-1]:
                        found[g] += 1
            self.grams.append({g for g, n in found.items() if n >= least})
            self.counts.update({g: found[g] for g in self.grams[-1]})
        self.order = order
        self.by = {}
        for g in self.counts:
            self.by.setdefault(g[:-1], []).append(g[-1])

    def p1(self, w):
        return (self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def total(self, h):
        return self.counts[h] if len(h) > 1 else self.context[h[0]]

    def p(self, w, h):
        if not h:
            return self.p1(w)
        if (*h, w) in self.counts:
            return (self.counts[(*h, w)] - lm.DISCOUNT) / self.total(h)
        kids = self.by.get(h)
        if not kids:
            return self.p(w, h[1:])
        left = 1 - sum((self.counts[(*h, x)] - lm.DISCOUNT) / self.total(h) for x in kids)
        rest = 1 - sum(self.p(x, h[1:]) for x in kids)
        return max(left, 1e-9) / max(rest, 1e-9) * self.p(w, h[1:])

    def score(self, text):
        w = ["<s>", *words(text)]
        return sum(math.log10(self.p(w[i], tuple(w[max(0, i - self.order + 1):i]))) for i in range(1, len(w)))

    def base(self, text):
        return sum(math.log10(self.p1(w)) for w in words(text))


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0


def fixture():
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocab[:rng.choice([5, 60])]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "W1 w2\tW3"), (204, "new words here"), (205, "w1 " * 9000), (None, "w3 w4")]
    return rows + [(3, rows[3][1])] * 2


@pytest.mark.parametrize("order, block_bytes", [(1, 900), (2, 900), (3, 900), (4, 900), (3, 1 << 20)])
def test_scores_equal_the_definition(spark, order, block_bytes, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1 << 12)
    monkeypatch.setattr(lm, "SEGMENT", 7)
    rows = fixture()
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, held int, block string")
    got = lm.lm_scores(df, order=order).collect()
    model = Plain([t for d, t in rows if not held(d)], order)
    want = sorted(((d, held(d), len(words(t)), sum(model.c[w] > 0 for w in words(t)), model.n, t) for d, t in rows), key=repr)
    by_id = {d: t for d, t in rows}
    assert len(got) == len(rows)
    for r in got:
        t = by_id[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(words(t)), model.n)
        assert r.n_known == sum(model.c[w] > 0 for w in words(t))
        assert abs(r.base_score - model.base(t)) < 1e-6 and abs(r.score - model.score(t)) < 1e-6
    assert len(want) == len(rows)


def test_every_context_sums_to_one():
    texts = [t for d, t in fixture() if not held(d)]
    model = Plain(texts)
    for h in [(), ("<s>",), ("w1",), ("w1", "w2"), ("w4", "w1"), ("<s>", "w1")]:
        total = sum(model.p(w, h) for w in model.c) + model.p("never seen", h)
        assert abs(total - 1) < 1e-9


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    rows = lm.op4_lm_scoring(spark, SF).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_table_and_no_training_rows(spark):
    df = spark.createDataFrame([(d, "a b") for d in range(400) if held(d)], "doc_id long, text string")
    assert lm.lm_scores(df.limit(0)).collect() == []
    got = lm.lm_scores(df).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(3, 0, 0)}
    assert all(np.isfinite(r.score) and abs(r.score - r.base_score) < 1e-9 for r in got)


def test_ngrams_seen_twice_are_kept_in_a_large_corpus(spark):
    """With more than 2^21 training tokens a bigram seen twice still makes its second word likelier."""
    filler = " ".join(f"f{i % 50}" for i in range(60_000))
    train = [d for d in range(1, 60) if not held(d)][:40]
    rows = [(d, filler) for d in train] + [(d, "qa qb qc") for d in [d for d in range(100, 120) if not held(d)][:2]]
    rows.append((next(d for d in range(200, 260) if held(d)), "qa qb qc"))
    got = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    r = got[rows[-1][0]]
    assert r.train_tokens > 2 << 20 and r.held_out
    # p(qa | start) = 1.4 / 42, p(qb | start qa) = p(qc | qa qb) = p(end | qb qc) = 1.4 / 2
    assert abs(r.score - (math.log10(1.4 / 42) + 3 * math.log10(0.7))) < 1e-6


def test_a_block_read_by_several_tasks_counts_once(spark, tmp_path):
    """Row groups of one block in several partitions."""
    rows = fixture()
    path = str(tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}), path, row_group_size=10)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        docs = spark.read.parquet(path)
        assert docs.rdd.getNumPartitions() > 2
        got = lm.lm_scores(docs).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    model, by_id = Plain([t for d, t in rows if not held(d)]), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = by_id[r.doc_id]
        assert (r.n_known, r.train_tokens) == (sum(model.c[w] > 0 for w in words(t)), model.n)
        assert abs(r.base_score - model.base(t)) < 1e-6 and abs(r.score - model.score(t)) < 1e-6
