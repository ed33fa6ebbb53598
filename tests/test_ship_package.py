"""Fits that start at the same time ship the package once."""

from concurrent.futures import ThreadPoolExecutor

from tabsmith import session as se


def test_threads_ship_once(spark, monkeypatch):
    sc, sent = spark.sparkContext, []
    monkeypatch.setattr(sc, "_tabsmith_shipped", False, raising=False)
    monkeypatch.setattr(sc, "addPyFile", lambda path: sent.append(path))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: se.ship_package(spark), range(8)))
    assert len(sent) == 1
