"""CSV edge cases (FIXTURES F7), written into a fresh temporary folder."""

import os
import tempfile

import pytest

from tabsmith.sources.csv import load_csv, require_nonempty


def _write(name, data: bytes) -> str:
    d = tempfile.mkdtemp(prefix="tabsmith-csv-")
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_short_long_rows_and_na(spark):
    p = _write("rows.csv", b'a,b,c\n1,x,2.5\n2,y\n3,z,4,5\n4,NA,n/a\n5,"q,r",\n')
    df = load_csv(spark, p)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(1, "x", 2.5), (2, "y", None), (4, None, None), (5, "q,r", None)]
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "double"}


def test_latin1_fallback(spark):
    p = _write("latin.csv", "name,n\ncafé,1\n".encode("latin-1"))
    assert load_csv(spark, p).first()["name"] == "café"


def test_duplicate_labels(spark):
    p = _write("dup.csv", b"a,b,a\n1,2,3\n")
    assert load_csv(spark, p).columns == ["a", "b", "a_1"]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_separators(spark, sep):
    text = sep.join(["k", "v"]) + "\n" + sep.join(["1", "a"]) + "\n" + sep.join(["2", "b"]) + "\n"
    df = load_csv(spark, _write("sep.csv", text.encode()))
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a"), (2, "b")]


def test_type_mix(spark):
    p = _write("types.csv", b"i,b,d\n1,True,2024-01-01\n,False,2024-01-02\n3,,2024-01-03\n")
    df = load_csv(spark, p)
    assert dict(df.dtypes) == {"i": "double", "b": "string", "d": "string"}


def test_complete_booleans(spark):
    p = _write("bools.csv", b"b,n\nTrue,1\nfalse,2\n")
    assert dict(load_csv(spark, p).dtypes)["b"] == "boolean"


def test_header_only_is_empty(spark):
    p = _write("empty.csv", b"a,b\n")
    with pytest.raises(ValueError):
        require_nonempty(load_csv(spark, p))


def test_strict_rejects_long_rows(spark):
    p = _write("strict.csv", b"a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValueError):
        load_csv(spark, p, seps=(",",), on_bad="fail")
