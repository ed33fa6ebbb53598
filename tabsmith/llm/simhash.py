"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has a bit set where more than half of its shingles' 64-bit
hashes have it set. Fingerprints link at ``BITS`` (3) or fewer differing bits.

1. Equal fingerprints are one vertex, so a group of copies costs one.
2. A fingerprint is cut into two segments only; of two linked fingerprints, one
   segment differs by at most one bit. Each segment is indexed under all its
   variants with one bit deleted: two segments that differ by at most one bit
   have the variant without that bit in common. Equality of a variant brings
   fingerprints together, and their whole distance is verified.
3. A pair that differs in the deleted bit meets under that variant alone; a pair
   of equal segments is looked at only under the first variant. Within a group,
   a search over the members not yet reached gives the edges of a spanning
   forest, so a group of m members gives fewer than m edges and no list of pairs.
4. Members of a group above ``GROUP`` are indexed again by the same method on
   the other segment (two halves, one bit deleted), and once more on the rest.
   There only eight bits and three deleted ones are free, so a group holds at
   most 2048 distinct fingerprints and is searched whole.
5. The edges make components, whose smallest doc_id is the result.

Defined cases: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; fewer words than a shingle are one shingle. Rows
that repeat a doc_id keep a row each. A row with a null doc_id takes part; a
component without any doc_id has a null component_id. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.components import components
from tabsmith.llm.store import documents, save, ship
from tabsmith.llm.textbatch import string_buffers, word_pieces

WORDS = 3
SEED = 42
BITS = 3
#: Larger groups are indexed once more.
GROUP = 1024
#: Shingles hashed at a time.
CHUNK = 1 << 16
#: Fingerprints with so many documents are placed by a broadcast join; there are at most total / HOT_SHARE of them.
HOT_SHARE = 200
U = np.uint64


# ---------------------------------------------------------------- fingerprints

def fingerprint(raw: bytes) -> int:
    """The SimHash of a text in UTF-8, unsigned."""
    n, bits = 0, np.zeros(64, np.int64)
    held: list[bytes] = []                  # the words that the next shingles begin with
    for words in word_pieces(raw.lower()):  # of bytes: A-Z and ASCII white space only
        held += words
        if len(held) >= WORDS:
            n += _add_bits(held, WORDS, bits)
            held = held[1 - WORDS:]
    if not n and held:
        n = _add_bits(held, len(held), bits)
    return int(np.packbits(2 * bits > n, bitorder="little").view(U)[0])


def _add_bits(words: list[bytes], size: int, bits: np.ndarray) -> int:
    """Adds the bits of the hashes of all runs of ``size`` words; their number."""
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - size + 1]
    ends = ends[size - 1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        h = np.array([digest(text[s:e], SEED) for s, e in zip(starts[i:i + CHUNK].tolist(), ends[i:i + CHUNK].tolist())], U)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return len(starts)


def _fingerprints(batches):
    for b in batches:
        raw, offsets = string_buffers(b.column(1))
        raw, at = raw.data, offsets.tolist()
        made = np.array([fingerprint(bytes(raw[s:e])) for s, e in zip(at, at[1:])], U)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])


# ------------------------------------------------------------------- signatures

def _without(value: np.ndarray, width: int) -> np.ndarray:
    """All variants of ``width``-bit values with one bit deleted, a row a value."""
    bit = np.arange(width, dtype=U)
    low = (U(1) << bit) - U(1)
    v = value[:, None]
    return (v & low) | ((v >> U(1)) & ~low)


def _segments(level: int, key: np.ndarray) -> tuple[np.ndarray, int]:
    """For each key of the level before, where the part still free begins, and the width of its halves.

    A key holds its choices as (half, deleted bit) bytes; level 1 has none."""
    if level == 1:
        return np.zeros(len(key), U), 32
    first = (key >> U(5)) & U(1)                        # the half of level 1
    start = (U(1) - first) * U(32)                      # the other one is free
    if level == 2:
        return start, 16
    second = (key >> U(13)) & U(1)
    return start + (U(1) - second) * U(16), 8


def signatures(level: int, fp: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, path, value) of all variants of this level.

    ``path`` is the choices so far: a byte a level, the half in bit 5 and the deleted bit below it."""
    start, width = _segments(level, path)
    shift = U(8 * (level - 1))
    index, paths, values = [], [], []
    for half in (0, 1):
        part = (fp >> (start + U(half * width))) & U((1 << width) - 1)
        values.append(_without(part, width).ravel())
        choice = (U(half << 5) | np.arange(width, dtype=U)) << shift
        paths.append((path[:, None] | choice).ravel())
        index.append(np.repeat(np.arange(len(fp)), width))
    return np.concatenate(index), np.concatenate(paths), np.concatenate(values)


def _variants(level: int):
    """(path, value, fp) rows of fingerprints; value carries the values of the levels before, too."""
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(U)
            path, before = ((b.column(i).to_numpy().view(U) for i in (1, 2)) if level > 1 else (np.zeros(len(fp), U),) * 2)
            for i in range(0, len(fp), 4096):
                part = slice(i, i + 4096)
                at, paths, values = signatures(level, fp[part], path[part])
                # 31, 15 and 7 bits: side by side they fit a long
                values = values | (before[part][at] << U({1: 0, 2: 15, 3: 7}[level]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)) for a in (paths, values, fp[part][at])], names=["path", "value", "fp"])
    return run


def _deleted(path: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The place in the fingerprint of the bit that the last choice deleted, and whether it is its segment's first."""
    start, width = _segments(level, path)
    choice = path >> U(8 * (level - 1))
    bit = choice & U(31)
    return start + ((choice >> U(5)) & U(1)) * U(width) + bit, bit == 0


#: ``_deleted``'s place for the levels that hand groups on, in SQL.
_DELETED_SQL = {1: "path & 63", 2: "(1 - (path >> 5 & 1)) * 32 + (path >> 13 & 1) * 16 + (path >> 8 & 31)"}


# --------------------------------------------------------------------- searching

def forest(a: np.ndarray, b: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``a`` (``b``: only between the two)."""
    free = [a] if b is None else [a, b]
    edges: list[tuple[int, int]] = []
    while all(len(f) for f in free):
        queue = [(0, free[0][0])]
        free[0] = free[0][1:]
        while queue:
            side, x = queue.pop()
            other = len(free) - 1 - side
            f = free[other]
            if not len(f):
                continue
            near = np.bitwise_count(f ^ x) <= BITS
            if near.any():
                found = f[near]
                free[other] = f[~near]
                edges.extend((int(x), int(y)) for y in found)
                queue.extend((other, y) for y in found)
    return edges


def _search(level: int):
    """Edges (kind 0: u, v) of groups that come sorted by (path, value, fp); members of large ones (kind 1: fp, path, value)."""
    whole = level == 3

    def run(batches):
        held = [np.zeros(0, U)] * 3
        large = None                        # the (path, value) whose members are handed on
        for b in batches:
            cols = [np.concatenate([h, b.column(i).to_numpy().view(U)]) for i, h in enumerate(held)]
            path, value, fp = cols
            if not len(path):
                continue
            fresh = np.flatnonzero((path[1:] != path[:-1]) | (value[1:] != value[:-1])) + 1
            cut = np.concatenate([[0], fresh, [len(path)]])
            if large is not None and (int(path[0]), int(value[0])) == large:
                yield members(path[:cut[1]], value[:cut[1]], fp[:cut[1]])
                if len(cut) == 2:
                    held = [c[:0] for c in cols]
                    continue
                cut = cut[1:]
            large = None
            last = int(cut[-2])
            if not whole and len(path) - last > GROUP:
                large = (int(path[last]), int(value[last]))
                yield members(path[last:], value[last:], fp[last:])
                held = [c[:0] for c in cols]
            else:
                held = [c[last:] for c in cols]
            yield from groups(path, value, fp, cut[:-1])
        if len(held[0]):
            yield from groups(*held, np.array([0, len(held[0])]))

    def members(path, value, fp):
        return rows(1, fp, path, value)

    def rows(kind, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32))] + [pa.array(x.view(np.int64)) for x in (a, b, c)],
                                          names=["kind", "a", "b", "c"])

    def groups(path, value, fp, cut):
        """The groups between the places in ``cut``."""
        begin, size = cut[:-1], np.diff(cut)
        many = size > 1
        if not many.any():
            return
        place, first = _deleted(path[begin], level)
        bit = ((fp[begin[0]:cut[-1]] >> np.repeat(place, size)) & U(1)).astype(np.int64)
        ones = np.add.reduceat(bit, begin - begin[0])
        # under a later variant only pairs that differ in the deleted bit are looked at
        many &= first | ((ones > 0) & (ones < size))
        two = many & (size == 2)
        x, y = fp[begin[two]], fp[begin[two] + 1]
        near = np.bitwise_count(x ^ y) <= BITS
        if near.any():
            yield rows(0, x[near], y[near], np.zeros(int(near.sum()), U))
        out: list[tuple[int, int]] = []
        for g in np.flatnonzero(many & ~two).tolist():
            lo, hi = int(begin[g]), int(begin[g] + size[g])
            if not whole and hi - lo > GROUP:
                yield members(path[lo:hi], value[lo:hi], fp[lo:hi])
                continue
            m = fp[lo:hi]
            if first[g]:
                out += forest(m)
            else:
                on = bit[lo - int(begin[0]):hi - int(begin[0])] == 1
                out += forest(m[on], m[~on])
            if len(out) > 100_000:
                yield flush(out)
        if out:
            yield flush(out)

    def flush(out):
        e = np.array(out, U)
        out.clear()
        return rows(0, e[:, 0], e[:, 1], np.zeros(len(e), U))
    return run


def links(fps: DataFrame) -> DataFrame:
    """(u, v) edges whose components are those of all links among distinct fingerprints (column fp)."""
    found = None
    now, edges = fps.select("fp"), []
    for level in (1, 2, 3):
        rows = now.mapInArrow(_variants(level), "path long, value long, fp long")
        rows = rows.repartition("path", "value").sortWithinPartitions("path", "value", "fp")
        found = save(rows.mapInArrow(_search(level), "kind int, a long, b long, c long"), f"simhash-level-{level}")
        edges.append(found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
        if level == 3:
            break
        large = found.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("path"), F.col("c").alias("value"))
        # a large group under a later variant needs pairs that differ in the deleted bit
        choice = F.shiftright("path", 8 * (level - 1)).bitwiseAND(31)
        bit = F.expr(f"shiftrightunsigned(fp, cast({_DELETED_SQL[level]} as int)) & 1")
        alive = save(large.groupBy("path", "value").agg(F.min(bit).alias("lo"), F.max(bit).alias("hi"))
                     .where((choice == 0) | (F.col("lo") < F.col("hi"))).select("path", "value"), "simhash-large")
        if not alive.limit(1).count():
            break
        now = large.join(alive, ["path", "value"]).select("fp", "path", "value")
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = save(docs.mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash-rows")
    fps = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    roots = save(components(links(fps)), "simhash-roots")
    placed = (fps.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = save(placed.join(least, "root").select(F.col("fp").alias("of"), "n", "component_id"), "simhash-placed")
    total = placed.agg(F.sum("n")).first()[0] or 0
    # fingerprints of many documents (fewer than HOT_SHARE of them) are placed without a shuffle
    hot = F.col("n") > total / HOT_SHARE
    often = placed.where(hot).select(F.col("of").alias("hot"), F.col("component_id").alias("hot_id"))
    marked = rows.join(F.broadcast(often), F.col("fp") == F.col("hot"), "left")
    cold = (marked.where("hot IS NULL").select("doc_id", "fp")
            .join(placed.where(~hot), F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id"))
    warm = marked.where("hot IS NOT NULL").select("doc_id", "fp", F.col("hot_id").alias("component_id"))
    return cold.unionByName(warm).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))
