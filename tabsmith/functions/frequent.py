"""Counts and most frequent values of text columns, without shuffling the texts.

A value travels as its key: the value itself up to KEY_BYTES, else its first HEAD
bytes with the MD5 of the whole, one byte longer so that no value looks like it.
Keys order values by their first HEAD bytes, which settles nearly all ties; what
remains tied is settled on longer and longer heads of the tied values alone, and
texts are fetched for the winners only.

``modes`` asks a mergeable frequent-items sketch first (hashes, estimated counts
and an error bound, a fixed size a column): where the sketch proves that the most
frequent value is among its candidates, only these are counted. Otherwise all
keys are. Both give the same answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col, columns_info
from tabsmith.session import materialize

HEAD, KEY_BYTES = 16, 32
#: Tied values whose whole texts are fetched at once; above it, heads grow first.
FETCH = 10_000
GROWTH = 16
#: Items a sketch holds, and candidates of it that are counted exactly.
SKETCH_ITEMS, CANDIDATES = 4096, 64


def key_of(value: Column) -> Column:
    """A value's key, as binary."""
    raw = value.cast("binary")
    long = F.concat(F.substring(raw, 1, HEAD), F.unhex(F.md5(raw)), F.lit(b"\x00"))
    return F.when(F.octet_length(value) <= KEY_BYTES, raw).otherwise(long)


def head_of(key: Column, size: int = HEAD) -> Column:
    return F.substring(key.cast("binary"), 1, size)


def _values(df: DataFrame, names: list[str]) -> DataFrame:
    """(ordinal, value) of all non-missing cells of the columns, each cell once."""
    pos = {c.name: c.ordinal for c in columns_info(df)}
    items = F.array(*[F.struct(F.lit(pos[n]).cast("bigint").alias("ordinal"), col(n).cast("string").alias("value"))
                      for n in names])
    return df.select(F.inline(items)).where(F.col("value").isNotNull())


def key_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(ordinal, key, count) of the distinct values of the columns; a few bytes a value are shuffled."""
    return (_values(df, names).select("ordinal", key_of(F.col("value")).alias("key"))
            .groupBy("ordinal", "key").agg(F.count(F.lit(1)).alias("count")))


def _texts(df: DataFrame, names: list[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (ordinal, key, ...; at most FETCH keys and the winners of a column) with each key's value."""
    found = _values(df, names).withColumn("key", key_of(F.col("value")))
    long = wanted.where(F.octet_length("key") > KEY_BYTES)
    fetched = (found.where(F.octet_length("key") > KEY_BYTES)
               .join(F.broadcast(long.select("ordinal", "key")), ["ordinal", "key"], "left_semi")
               .groupBy("ordinal", "key").agg(F.first("value").alias("value")))
    short = wanted.where(F.octet_length("key") <= KEY_BYTES).withColumn("value", F.decode("key", "utf-8"))
    return short.unionByName(long.join(fetched, ["ordinal", "key"]))


def _first_tied(df: DataFrame, name: str, ordinal: int, tied: DataFrame, head: bytes, need: int) -> DataFrame:
    """Keys that include the ``need`` smallest values among ``tied`` (key), more than FETCH keys that begin with ``head``:
    fewer than ``need`` of them, and at most FETCH of those that are still tied."""
    size, sure = HEAD, []
    values = _values(df, [name]).where(F.octet_length("value") > KEY_BYTES)
    while True:
        size *= GROWTH
        begins = head_of(F.col("value"), len(head)) == F.lit(bytes(head))
        long = tied.where(F.octet_length("key") > KEY_BYTES)
        grown = (values.where(begins).select(key_of(F.col("value")).alias("key"), head_of(F.col("value"), size).alias("head"))
                 .groupBy("key").agg(F.first("head").alias("head")).join(long, "key", "left_semi"))
        short = tied.where(F.octet_length("key") <= KEY_BYTES).select("key", F.col("key").alias("head"))
        grown = materialize(grown.unionByName(short))
        last = grown.orderBy("head").limit(need).collect()
        head = bytes(last[-1]["head"])
        sure += [bytes(r["key"]) for r in last if bytes(r["head"]) < head]
        need -= sum(bytes(r["head"]) < head for r in last)
        tied = grown.where(F.col("head") == F.lit(head)).select("key")
        n = tied.count()
        # a head shorter than its size is a whole value: only one key can have it
        if n <= FETCH:
            break
    spark = df.sparkSession
    return (spark.createDataFrame([(k,) for k in sure], "key binary").unionByName(tied)
            .select(F.lit(ordinal).cast("bigint").alias("ordinal"), "key"))


def most_frequent(df: DataFrame, names: list[str], counts: DataFrame, k: int) -> DataFrame:
    """(ordinal, rank, value, count) of each column's k most frequent values, smaller values first among equal
    counts; ``counts`` are the columns' ``key_counts``, read several times."""
    spark = df.sparkSession
    pos = {c.name: c.ordinal for c in columns_info(df)}
    head = head_of(F.col("key"))
    tops = [counts.where(F.col("ordinal") == pos[n]).withColumn("head", head)
            .orderBy(F.desc("count"), "head").limit(k) for n in names]
    top = reduce(DataFrame.unionByName, tops).collect()                 # k rows a column
    border = {}
    for r in top:
        now = border.get(r["ordinal"])
        if now is None or (-r["count"], bytes(r["head"])) > now:
            border[r["ordinal"]] = (-r["count"], bytes(r["head"]))
    if not border:
        return spark.createDataFrame([], "ordinal bigint, rank bigint, value string, count bigint")
    sure = [(r["ordinal"], bytes(r["key"]), r["count"]) for r in top if (-r["count"], bytes(r["head"])) < border[r["ordinal"]]]
    at_border = reduce(lambda a, b: a | b, [
        (F.col("ordinal") == o) & (F.col("count") == -c) & (head == F.lit(h)) for o, (c, h) in border.items()])
    tied = counts.where(at_border)
    sizes = {r["ordinal"]: r["n"] for r in tied.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = [n for n in names if sizes.get(pos[n], 0) > FETCH]
    few = tied.where(~F.col("ordinal").isin([pos[n] for n in wide])) if wide else tied
    parts = [spark.createDataFrame(sure, "ordinal bigint, key binary, count bigint"), few.select("ordinal", "key", "count")]
    for n in wide:
        o = pos[n]
        need = k - sum(s[0] == o for s in sure)
        first = _first_tied(df, n, o, tied.where(F.col("ordinal") == o).select("key"), border[o][1], need)
        parts.append(first.withColumn("count", F.lit(-border[o][0]).cast("bigint")))
    wanted = materialize(reduce(DataFrame.unionByName, parts))
    found = materialize(_texts(df, names, wanted))
    return ranked(found, sorted(border), k)


def ranked(found: DataFrame, ordinals: list[int], k: int) -> DataFrame:
    """The first k rows (ordinal, value, count) of each column, with their rank."""
    by = [F.desc("count"), F.asc("value")]
    rows = reduce(DataFrame.unionByName, [found.where(F.col("ordinal") == o).orderBy(*by).limit(k) for o in ordinals])
    listed = rows.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "value"))).alias("all"))
    return (listed.select("ordinal", F.posexplode("all").alias("p", "r"))
            .select("ordinal", (F.col("p") + 1).cast("bigint").alias("rank"), F.col("r.value").alias("value"),
                    (-F.col("r.c")).alias("count")))


# ----------------------------------------------------------------------- modes

def sketch_error(rows: int, items: int = SKETCH_ITEMS) -> int:
    """How far a sketch's estimate can be from a count, and the most an item not in it can have."""
    size = 1
    while size * 3 < items * 4:         # the sketch's table is a power of two, three quarters full
        size *= 2
    return -(-7 * rows // (2 * size))


def frequent_hashes(df: DataFrame, names: list[str]) -> dict[str, tuple[int, list[tuple[int, int]]]]:
    """Per column an error bound and the (hash, estimate) of its frequent values, in one pass.

    A value's count is at most its estimate, and at least that less the error; one that
    is not listed has at most twice the error, or the least estimate of a full list."""
    out = {}
    for i in range(0, len(names), 8):
        part = names[i:i + 8]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for k, n in enumerate(part):
            v = col(n).cast("string")
            aggs.append(F.call_function("approx_top_k", F.when(v.isNotNull(), F.xxhash64(v)), F.lit(CANDIDATES),
                                        F.lit(SKETCH_ITEMS)).alias(f"t{k}"))
        row = df.agg(*aggs).first()
        for k, n in enumerate(part):
            out[n] = (sketch_error(row["rows"]), [(r["item"], r["count"]) for r in row[f"t{k}"] or []])
    return out


def proven_modes(error: int, items: list[tuple[int | None, int]]) -> list[int] | None:
    """The hashes that may be a column's mode, if the sketch leaves no others (the item None counts missing cells)."""
    listed = [(h, c) for h, c in items if h is not None]
    best = max((c for _, c in listed), default=0)
    if best <= 3 * error:
        return None
    if len(items) >= CANDIDATES and min(c for _, c in items) >= best - error:
        return None
    return [h for h, c in listed if c >= best - error]


def modes(df: DataFrame, names: list[str]) -> dict[str, str]:
    """The most frequent value of each column, the smallest among equal counts; a column without values is left out."""
    if not names:
        return {}
    proven, rest = {}, []
    for n, (error, items) in frequent_hashes(df, names).items():
        hashes = proven_modes(error, items)
        if hashes:
            proven[n] = hashes
        else:
            rest.append(n)
    out: dict[str, str] = {}
    if proven:
        pos = {c.name: c.ordinal for c in columns_info(df)}
        wanted = reduce(lambda a, b: a | b, [(F.col("ordinal") == pos[n]) & F.xxhash64("value").isin(hs) for n, hs in proven.items()])
        counts = materialize(_values(df, list(proven)).where(wanted).select("ordinal", key_of(F.col("value")).alias("key"))
                             .groupBy("ordinal", "key").agg(F.count(F.lit(1)).alias("count")))
        out.update(_mode_values(df, list(proven), counts))
    if rest:
        out.update(_mode_values(df, rest, materialize(key_counts(df, rest))))
    return out


def _mode_values(df: DataFrame, names: list[str], counts: DataFrame) -> dict[str, str]:
    label = {c.ordinal: c.name for c in columns_info(df)}
    return {label[r["ordinal"]]: r["value"] for r in most_frequent(df, names, counts, 1).collect()}
