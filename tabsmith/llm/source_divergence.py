"""Divergence of sources within their language, by row accumulation.

A term's share in a group is a whole number: p = 1 + floor(1e9 (count + 2) / (N + 2 V))
over the V kept terms of the language; two shares differ by f = floor((p - q)^2 / (p + q)).
The distance of two sources is the sum of f over all kept terms.

Only terms that a source has are ever touched. With z the share of a term it
does not have, the distance of s and t is

    V f(zs, zt) + sum over terms of s of f(ps, zt) - f(zs, zt)
                + sum over terms of t of f(zs, pt) - f(zs, zt)
                + sum over terms of both of f(ps, pt) - f(ps, zt) - f(zs, pt) + f(zs, zt).

1. Tasks count their documents' terms, and the documents that have them, in
   hash tables that are handed on when full; a term's rows meet by its hash.
2. The first three parts need a source's terms only by their distinct counts, of
   which a source with N words has less than sqrt(2 N): they are joined with the
   language's sources, not the terms.
3. The last part goes row by row (Gustavson): the terms of a task are its slice
   of the term-major index; each source's row scatters its terms through the
   slice into a dense accumulator over its peers. A task hands on one sum for
   two sources that share a term in the slice, and no pair of postings.
4. A source's first terms by f against the whole language are ranked; each task
   keeps its first ten of a source before they are shuffled.

All arithmetic is exact: counts in decimals, shares and f in longs (f <= 1e9, and
the sum of f is less than 2e9 + 2 V).

Defined cases: null text, lang and source are ''. A row is a document, also one
that repeats a doc_id. A source without terms is a group; a language without
kept terms has value 0 for all its pairs and no ``term`` rows; a lone source has no
``pair`` rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.store import documents, save, ship
from tabsmith.llm.textbatch import string_buffers, word_pieces

#: A term is kept with so many documents of its language.
MIN_DOCS = 10
#: Ranks of the ``term`` part.
TOP_TERMS = 10
UNIT, PRIOR = 1_000_000_000, 2
#: Terms a task holds before it hands its counts on, and postings of one slice of the index.
HELD_TERMS = 400_000
SLICE = 1 << 18

#: Letters and all bytes of non-ASCII code points stay, A-Z in lower case; the rest separates.
TERM_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


# ------------------------------------------------------------------------ counts

def _count(most: int):
    """(lang, source, term, n, docs): occurrences and documents of each term; term null: documents of the group.

    Counts are handed on at ``most`` terms."""
    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        groups: Counter = Counter()
        size = 0

        def flush():
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                k = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]).take(pa.array(np.zeros(k, np.int32))), pa.array([source]).take(pa.array(np.zeros(k, np.int32))),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                     pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches:
            raw, offsets = string_buffers(b.column(2))
            raw, at = raw.data, offsets.tolist()
            for d, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                groups[key] += 1
                found: set[bytes] = set()
                for words in word_pieces(bytes(raw[at[d]:at[d + 1]]).translate(TERM_BYTES)):
                    n, docs = held.get(key) or held.setdefault(key, (Counter(), Counter()))
                    before = len(n)
                    n.update(words)
                    fresh = set(words) - found
                    docs.update(fresh)
                    found |= fresh
                    size += len(n) - before
                    if size >= most:
                        yield from flush()
                        size = 0
        yield from flush()
        keys = list(groups)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.nulls(len(keys), pa.string()), pa.array(list(groups.values()), pa.int64()),
             pa.array([0] * len(keys), pa.int64())], names=["lang", "source", "term", "n", "docs"])
    return run


def share(count, total, kept):
    """The share of a term with ``count`` among ``total`` occurrences of ``kept`` terms, exactly, as a long."""
    d = lambda c: c.cast("decimal(24,0)")
    unit = F.lit(UNIT).cast("decimal(10,0)")
    top, low = unit * (d(count) + PRIOR), d(total) + d(kept) * PRIOR
    return F.lit(1) + F.call_function("div", top, low)


def distance(p, q):
    """f of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


# ------------------------------------------------------------- row accumulation

def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def accumulate(term: np.ndarray, row: np.ndarray, p: np.ndarray, z: np.ndarray, rows: int):
    """For each row: (row, peers, sums of the correction over the terms of both).

    A posting is a row's share ``p`` of a term, beside the row's share ``z`` of a missing one;
    postings come sorted by term, so they are the term-major index."""
    cut = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1, [len(term)]])
    size = np.diff(cut)
    index = np.repeat(np.arange(len(size)), size)           # a posting's term
    order = np.argsort(row, kind="stable")                  # the row-major view of the same postings
    ends = np.searchsorted(row[order], np.arange(rows + 1))
    acc, seen = np.zeros(rows, np.int64), np.zeros(rows, bool)
    for r in range(rows):
        mine = order[ends[r]:ends[r + 1]]
        length = size[index[mine]]
        begin = np.repeat(cut[index[mine]] - (np.cumsum(length) - length), length)
        peer = begin + np.arange(int(length.sum()))         # all postings of the row's terms
        ps, zs = np.repeat(p[mine], length), np.repeat(z[mine], length)
        pt, zt = p[peer], z[peer]
        np.add.at(acc, row[peer], _f(ps, pt) - _f(ps, zt) - _f(zs, pt) + _f(zs, zt))
        seen[row[peer]] = True
        seen[r] = False
        peers = np.flatnonzero(seen)
        if len(peers):
            yield r, peers, acc[peers]
        acc[:], seen[:] = 0, False


def _scatter(most: int):
    """(s, t, correction) sums of slices of about ``most`` postings: rows (number of a term, g, p, z) that come sorted."""
    def run(batches):
        held: list[np.ndarray] | None = None

        def slice_sums(cols):
            term, g, p, z = cols
            names, row = np.unique(g, return_inverse=True)
            for r, peers, sums in accumulate(term, row, p, z, len(names)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(peers), names[r])), pa.array(names[peers]), pa.array(sums)], names=["s", "t", "part"])

        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(4)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) >= most:
                last = int(np.searchsorted(held[0], held[0][-1]))           # the last term may go on
                if last:
                    yield from slice_sums([c[:last] for c in held])
                    held = [c[last:] for c in held]
        if held is not None and len(held[0]):
            yield from slice_sums(held)
    return run


# ------------------------------------------------------------------------ audit

def source_divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
                      text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of ``docs``."""
    ship(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias
    docs = docs.select(text(lang_col)("lang"), text(source_col)("source"), text(text_col)("text"))
    counted = docs.mapInArrow(_count(HELD_TERMS), "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = save(counted, "divergence-counts")
    terms = counted.where("term IS NOT NULL")
    kept = (terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "all_n", F.monotonically_increasing_id().alias("number")))
    kept = save(kept, "divergence-kept")            # written, so that a term's number stays
    index = save(terms.select("lang", "term", "source", "n").join(kept, ["lang", "term"]), "divergence-index")

    # groups and languages with their totals
    groups = counted.where("term IS NULL").select("lang", "source")
    sums = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("all_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    zero = F.lit(0).cast("long")
    groups = (groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "kept")]))
    groups = groups.withColumn("z", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.greatest("kept", F.lit(1)))))
    groups = save(groups.withColumn("g", F.monotonically_increasing_id()), "divergence-groups")
    shares = (index.join(groups, ["lang", "source"])
              .select("lang", "term", "number", "source", "g", "z", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
                      share(F.col("all_n"), F.col("lang_total"), F.col("kept")).alias("q")))
    shares = save(shares, "divergence-shares")

    # terms of both
    postings = shares.select("number", "g", "p", "z").repartition("number").sortWithinPartitions("number", "g")
    both = postings.mapInArrow(_scatter(SLICE), "s long, t long, part long").groupBy("s", "t").agg(F.sum("part").alias("part"))

    # terms of one, by distinct shares
    peer = groups.select("lang", F.col("g").alias("t"), F.col("z").alias("zt"))
    alone = shares.groupBy("lang", "g", "z", "p").agg(F.count(F.lit(1)).alias("terms")).join(peer, "lang").where("g <> t")
    gain = F.col("terms") * (distance(F.col("p"), F.col("zt")) - distance(F.col("z"), F.col("zt")))
    alone = alone.groupBy(F.col("g").alias("s"), "t").agg(F.sum(gain).alias("part"))
    alone = alone.unionByName(alone.select(F.col("t").alias("s"), F.col("s").alias("t"), "part"))

    parts = both.unionByName(alone).groupBy("s", "t").agg(F.sum("part").alias("part"))
    you = groups.select("lang", F.col("g").alias("t"), F.col("source").alias("item"), F.col("z").alias("zt"))
    base = F.when(F.col("kept") > 0, F.col("kept") * distance(F.col("z"), F.col("zt"))).otherwise(zero)
    pairs = (groups.join(you, "lang").where("g <> t")
             .select("lang", "source", F.col("g").alias("s"), "t", "item", base.alias("base"))
             .join(parts, ["s", "t"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("part", zero)).alias("value")))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    tops = (shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         distance(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms))
    return pairs.unionByName(tops)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


OP13_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS MATERIALIZED (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
langs AS MATERIALIZED (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(s.total, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) s USING (lang, source)),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM langs)),
tops AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops)
QUALIFY part = 'pair' OR rank <= 10
"""
