"""Quoted line breaks in files that are read in many ranges."""

import io
import os
import random
import tempfile

import pandas as pd
import pytest

from tabsmith.sources import quoted_lines as ql
from tabsmith.sources.csv import load_csv


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, "4096")
    yield
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def fields(rng, long: bool):
    texts = ['plain', 'a "quoted" word', 'comma, inside', 'two\nlines', '"', '""\n""', '\n\n', ' lead', 'trail ', 'x\r\ny',
             'semi;colon', 'tab\tbed', '5" pipe', 'ünïcode\nß', 'line1\nline2,3\n"q"\nlast']
    if long:
        texts.append("long\n" * rng.randrange(1, 2500) + 'with "quotes"')      # covers several ranges
    return rng.choice(texts)


def frame(seed, n=3000, long=True):
    rng = random.Random(seed)
    return pd.DataFrame({"k": range(n), "t": [fields(rng, long and rng.random() < 0.1) for _ in range(n)],
                         "u": [fields(rng, False) for _ in range(n)], "v": [rng.randrange(100) / 4 for _ in range(n)]})


def write(data: bytes, name="f.csv", folder=None) -> str:
    folder = folder or tempfile.mkdtemp(prefix="tabsmith-quoted-")
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)
    return os.path.join(folder, name)


def same(df, data: bytes, **kw):
    want = pd.read_csv(io.BytesIO(data), **kw)
    assert list(df.columns) == list(want.columns)
    key = lambda r: repr(r)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    clean = [tuple(None if x != x else x for x in r) for r in want.itertuples(index=False)]
    assert got == sorted(clean, key=key)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_ranges_give_pandas_rows(spark, small_splits, seed, end):
    data = frame(seed).to_csv(index=False, lineterminator=end).encode()
    path = write(data)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    same(load_csv(spark, path), data)


def test_no_range_border_matters(spark):
    """A break at every place of a border: the file grows by a byte at a time before a quoted field."""
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        for pad in range(0, 40, 3):
            data = ("a,b\n" + "x" * pad + ',"one\ntwo, ""three""\n\nfour"\n' * 1 + "y,1\n" + 'z,"p\nq"\n' * 8).encode()
            path = write(data)
            df = load_csv(spark, path)
            same(df, data)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_folder_header_latin1_and_separator(spark, small_splits):
    data = frame(3, 300).to_csv(index=False, sep=";").encode("utf-8")
    folder = os.path.dirname(write(data, "a.csv"))
    write(data, "b.csv", folder)
    want = pd.read_csv(io.BytesIO(data), sep=";")
    got = load_csv(spark, folder)
    assert got.columns == list(want.columns) and got.count() == 2 * len(want)
    latin = 'näme,"head\ner"\n"é\nè",1\n"plain",2\n'.encode("latin-1")
    df = load_csv(spark, write(latin))
    assert df.columns == ["näme", "head\ner"]
    assert sorted(tuple(r) for r in df.collect()) == [("plain", 2), ("é\nè", 1)]


def test_bad_rows_and_open_end(spark, small_splits):
    data = b'a,b\n"x\ny",1\n"l\nong",2,3\n\n  \n"short\n"\n"e\nnd",4'
    assert sorted(map(tuple, load_csv(spark, write(data)).collect())) == [("e\nnd", 4.0), ("short\n", None), ("x\ny", 1.0)]
    with pytest.raises(ValueError):
        load_csv(spark, write(data), on_bad="fail")


def test_states():
    f = ql.ends_inside
    assert not f('a,"b",c', ",", False) and f('a,"b', ",", False) and f('x', ",", True) and not f('x"', ",", True)
    assert not f('5" pipe,b', ",", False)                   # a quote inside an unquoted field
    assert f('a""b', ",", True) and not f('a"""', ",", True) and f('","', ",", True) and f('"a"b"c,"d', ",", False)


def test_one_file_uses_many_tasks(spark, small_splits):
    path = write(frame(5).to_csv(index=False).encode())
    found = ql.quoted_records(spark, path, ",", "utf-8")
    assert found is not None and found.count() == 3001
    assert max(len(p) for p in found.rdd.glom().map(lambda rows: [1 for _ in rows]).collect()) < 1500
