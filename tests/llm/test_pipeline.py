"""The stages against plain Python on a small table."""
import numpy as np
import public_tokenizers as P

import corpus_pipeline as cp
from tabsmith.llm.quality_rules import op1_quality_rules
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_join

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    frames = []
    for name, stage in cp.STAGES:
        docs = cp.save(stage(spark, docs, SF), name)
        frames.append(docs)
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS)
    rules, classified, lines, joined, packed = ({r.doc_id: r.text for r in f.collect()} if "text" in f.columns else f.collect()
                                                for f in frames)
    kept = {r.doc_id for r in op1_quality_rules(spark, SF).where("kept").collect()}
    assert set(rules) == kept and all(before[d] == t for d, t in rules.items())
    good = [d for d in rules if labels.get(d) == 1]
    assert set(classified) <= set(rules) and sum(d in classified for d in good) >= 0.98 * len(good)
    assert sorted(lines.items()) == [(d, t) for d, _, _, t in brute_lines(sorted(classified.items()))]
    want = {d for d, _, c in brute_join(sorted(lines.items())) if d == c}
    assert set(joined) == want and all(lines[d] == t for d, t in joined.items())
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    got = {}
    for p in sorted(packed, key=lambda p: (p.doc_id, p.start)):
        got.setdefault(p.doc_id, []).extend(np.frombuffer(bytes(p.ids), "<u4").tolist())
    assert got == {d: t.encode(x, add_special_tokens=False).ids + [1] for d, x in joined.items()}


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = cp.save(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    docs = docs.unionByName(docs)
    out = cp.ngram_join_stage(spark, docs, SF)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) > 0


def test_documents_are_rows(spark):
    """Repeated and missing ids: only near duplicates go, whatever id they have."""
    a = " ".join(f"word{i}" for i in range(80))
    b = " ".join(f"other{i}" for i in range(80))
    rows = [(5, a), (5, b), (None, a + " end"), (None, b + " end"), (None, "alone " * 7), (7, a), (3, "x y z w v u t"),
            (9, None), (9, None), (None, ""), (2, b + " end")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "extra") for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, row string")
    got = cp.ngram_join_stage(spark, docs, SF)
    assert got.columns == list(cp.COLUMNS)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, [
        (5, a), (2, b + " end"), (None, "alone " * 7), (3, "x y z w v u t"), (9, None), (9, None), (None, "")]))


def test_stages_take_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, "word " * 60, None, "s", 3, 2), (1, "", "en", None, 0, 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long, score int")
    for name, stage in cp.STAGES:
        docs = cp.save(stage(spark, docs, SF), name)
    assert docs.count() == 0
