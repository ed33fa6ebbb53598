"""Packing, token files and byte-level BPE."""
import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import byte_bpe, packing, token_files
from tabsmith.llm.store import new_path
from tabsmith.llm.units import UnitEncoder

SF = "/root/testdata/sf0.001"
ALPHABET = list("ab  \n\t\r'sé$#1") + [chr(c) for c in (0x301, 0x130, 0xDF, 0xFF12, 0x1C, 0x85, 0xA0, 0x2003, 0x1D4B3)]


def random_texts(n=300):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return texts + ["", "a" * 3000, "ab" * 2000, "aab" * 700, " " * 500 + "x", "<|endoftext|> 's 'll", "x'll'll"]


def tokenizer(name):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


def ids_of(t, texts):
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_give_the_ids_of_whole_texts(name, kind):
    texts = random_texts()
    got = UnitEncoder(P.path(name), kind, 2).encode([*texts, None])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [*ids_of(tokenizer(name), texts), []]


def test_bpe_equals_tiktoken_and_round_trips():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = random_texts()
    got = bpe.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [want.encode_ordinary(t) for t in texts]
    decoder = byte_bpe.ByteDecoder(P.path("byte_bpe_50k.tiktoken"))
    assert [decoder.decode(x) for x in got] == [t.encode() for t in texts]


def test_rank_queue_takes_the_lowest_rank():
    q = byte_bpe.RankQueue(50_000)
    rng = random.Random(1)
    ranks = [rng.randrange(50_000) for _ in range(2000)]
    for r in ranks:
        q.push(r, np.array([r]))
    out = []
    while (item := q.pop()) is not None:
        out.append(item[0])
        assert (item[1] == item[0]).all()
    assert out == sorted(set(ranks))


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "ab ab", "z"), (3, "ab ab", "z")], "doc_id long, text string, ids string")
    out = byte_bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert out.columns == ["doc_id", "text", "_ids", "ids"]
    back = byte_bpe.decode(out, P.path("byte_bpe_50k.tiktoken")).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == ["", "", "ab ab", "ab ab"]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


# ------------------------------------------------------------------------ packing

def check_pieces(rows, want, tokens=2048):
    """The pieces hold each document's ids once, and each sequence's offsets are gapless."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    got = {}
    for d, ps in docs.items():
        ps.sort(key=lambda p: p.start)
        at = 0
        for p in ps:
            assert p.start == at and len(p.ids) == 4 * p.length > 0
            at += p.length
        assert at == ps[0].doc_tokens
        got[d] = np.frombuffer(b"".join(bytes(p.ids) for p in ps), "<u4").tolist()
    assert got == want
    pad = total = 0
    for ps in seqs.values():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at
            at += p.length
        assert at <= tokens
        pad += 0 if at & (at - 1) == 0 else tokens - at
        total += at
    return pad, total


def test_packed_documents_hold_every_id_once(spark):
    rows = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), P.path("word_bpe_49k.json")).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {d: i + [1] for d, i in zip(texts, ids_of(tokenizer("word_bpe_49k.json"), list(texts.values())))}
    pad, total = check_pieces(rows, want)
    assert pad == 0 and total == sum(map(len, want.values()))
    digest = packing.op5_packing(spark, SF).collect()
    assert {r.doc_id for r in digest} == set(texts)
    for r in digest:
        ids = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(ids) == r.ids_crc32


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "a " * 5000, 7)], "doc_id long, text string, ids long")
    rows = packing.pack_documents(df, P.path("word_bpe_49k.json")).collect()
    t = tokenizer("word_bpe_49k.json")
    check_pieces(rows, {1: [1], 2: [1], 3: ids_of(t, ["a " * 5000])[0] + [1]})
    assert packing.pack_documents(df.limit(0), P.path("word_bpe_49k.json")).collect() == []


def test_limits_hold_for_instruction_examples(spark):
    rng = random.Random(3)
    examples = []
    for i in range(400):
        n = rng.choice([3, 20, 60, 150, 700])
        cut = rng.randrange(n + 1)
        examples.append((i, list(range(n)), [k >= cut for k in range(n)]))
    examples += [(1000, None, None), (1001, [], []), (1002, [7] * 90, None), (1003, [7] * 500, [True] * 500)]
    limits = packing.Limits(tokens=256, segments=6, loss=120)
    df = spark.createDataFrame(examples, "id long, ids array<int>, loss_mask array<boolean>").repartition(3)
    rows = packing.pack_examples(df, limits=limits, pool=32).collect()
    check_pieces(rows, {i: ids for i, ids, _ in examples if ids}, 256)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for ps in seqs.values():
        assert len(ps) <= 6 and sum(p.loss_tokens for p in ps) <= 120
    # places used, padding included, against the least that the limits allow (a task's rest is in short sequences)
    share = max(sum(p.length for p in rows) / 256, len(rows) / 6, sum(p.loss_tokens for p in rows) / 120)
    assert sum(ps[0].padded for ps in seqs.values()) < 1.25 * 256 * share


# -------------------------------------------------------------------- token files

def test_token_files_round_trip(spark):
    manifest = token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet"), new_path(spark, "t"),
                                             P.path("byte_bpe_50k.json"), length=256)
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = [i + [2] for i in ids_of(tokenizer("byte_bpe_50k.json"), [t for _, t in texts])]
    got = token_files.read_documents(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [d for d, _ in texts]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    # random access by row
    for m in manifest.collect():
        flat = [x for (d, _), i in zip(texts, want) if m.first_doc <= d <= m.last_doc for x in i]
        assert len(flat) == m.n_tokens
        for row in {0, m.n_rows // 2, m.n_rows - 1}:
            ids, mask = token_files.read_sequence(m.path, row)
            part = flat[256 * row:256 * row + 256]
            assert len(ids) == 256 and np.count_nonzero(mask) == len(part) and ids[mask > 0].tolist() == part
            assert (ids[mask == token_files.END] == 2).all() and mask[len(part):].sum() == 0
            # both are views of the mapped file
            assert not ids.flags.owndata and not mask.flags.owndata and not mask.flags.writeable


def test_token_file_edges(spark):
    df = spark.createDataFrame([(2, "b", 1), (None, "a", 1), (2, "a", 1), (5, None, 1), (2, "a", 1), (4, "#" * 9000, 1)],
                               "doc_id long, text string, start long")
    m = token_files.write_token_files(df, new_path(spark, "t"), P.path("byte_bpe_50k.json"))
    got = token_files.read_documents(m).orderBy("start").collect()
    assert [r.doc_id for r in got] == [token_files.NO_DOC, 2, 2, 2, 4, 5]
    assert [r.n_tokens for r in got][:4] == [2] * 4 and got[-1].n_tokens == 1
    empty = token_files.write_token_files(df.limit(0), new_path(spark, "t"), P.path("byte_bpe_50k.json"))
    assert token_files.read_documents(empty).collect() == []


def test_one_repeated_id_and_no_id_fill_several_files(spark):
    rows = [(7 if i % 2 else None, f"text {i}") for i in range(4000)] + [(7, "text 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        m = token_files.write_token_files(df, new_path(spark, "t"), P.path("byte_bpe_50k.json"), length=64)
        files = m.orderBy("shard").collect()
        got = token_files.read_documents(m).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(files) > 4 and max(f.n_docs for f in files) < 1500
    assert [r.doc_id for r in got] == [token_files.NO_DOC] * 2000 + [7] * 2001
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    encoded = {tuple(i + [2]) for i in ids_of(tokenizer("byte_bpe_50k.json"), [t for _, t in rows])}
    assert {tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in got} == encoded


def test_token_query(spark):
    rows = token_files.op7_token_files(spark, SF).select("doc_id", "n_tokens", F.col("ids_crc32").cast("long").alias("c")).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    t = tokenizer("byte_bpe_50k.json")
    for r in rows:
        ids = ids_of(t, [texts[r.doc_id]])[0] + [2]
        assert (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == (r.n_tokens, r.c)
