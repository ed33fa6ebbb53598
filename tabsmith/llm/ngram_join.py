"""N-gram Jaccard join over prefix trees.

A document's set holds its distinct 5-word shingles (64-bit hashes, A-Z
lower-cased). Two documents link when their sets' Jaccard similarity is at least
``threshold``; the result is each document's component.

1. Equal sets are one vertex from here on, so a group of copies costs one set.
2. A fixed-size summary of all documents' shingles finds the frequent ones; the
   global order puts rare shingles first and frequent ones last, by frequency.
   (Any order gives the same links; this one keeps passages that many documents
   share out of the prefixes.)
3. Sets that link share a shingle in their prefixes (the first n - ceil(t n) + 1
   shingles), at places that leave enough shingles behind it. Each prefix shingle
   brings its sets together: of a few, all pairs within the bounds are
   candidates; of many, the pairs with the set that has the shingle first.
   A pair whose sketches (how many of a set's hashes fall into each of some n / 2
   buckets) already bound the overlap below what is needed is dropped: the sum of
   the smaller counts is never less than the overlap.
4. A candidate's partners are stored in a prefix tree, frequent shingles first,
   so that near copies share their paths: the sets sorted in that order, each
   with the depth at which it leaves the one before. The candidate walks the
   tree; the overlap of a shared path is counted once, and a subtree is left as
   soon as the shingles remaining on either side cannot reach the overlap
   needed. A tree holds at most TREE_SETS partners; more are dealt into more trees.
5. Links make components. Where a large group of step 3 still lies in several
   components, all its pairs across components that were not compared yet are
   candidates of a second round, so no link is lost.

Defined cases: a null or empty text, or one without words, has no shingles and
links with nothing; fewer than five words are one shingle; rows that repeat a
doc_id are one document for the component's smallest id and have a row each; a
null doc_id links with nothing and has a null component; an empty table gives an
empty result. Two different sets meet in one 64-bit hash with a chance of about
one in 10^19 a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.components import components
from tabsmith.llm.store import documents, save, ship
from tabsmith.llm.textbatch import mix, shingle_sets, tidy, word_slices

SHINGLE = 5
THRESHOLD = (75, 100)
#: Shingles a task counts before it hands on the most frequent, and how many those are.
COUNT_AT, LOCAL_TOP = 4 << 20, 20_000
#: Size of the summary of frequent shingles (8 bytes each); the others count as rare.
FREQUENT = 1 << 17
#: All pairs are candidates of a shingle with at most so many sets.
SMALL_GROUP = 24
TREE_SETS = 1024
#: Texts of candidate sets are found by a broadcast of their ids up to so many bytes.
BROADCAST_BYTES = 16 << 20
SEEN = 1 << 20
U = np.uint64


def set_hash(s: np.ndarray) -> int:
    """The 64-bit hash of a set, as a signed number."""
    h = mix(np.array([np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)))], np.uint64) + U(len(s)))
    return int(h.view(np.int64)[0])


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def needed(na, nb, num: int, den: int):
    """The least intersection of linked sets with na and nb members."""
    return -(-num * (na + nb) // (num + den))


class Order:
    """The global order: frequent shingles last, by rank; the others by hash."""

    def __init__(self, frequent: np.ndarray):
        rank = np.arange(1, len(frequent) + 1)          # frequent comes sorted from rare to common
        by = np.argsort(frequent)
        self.tokens, self.rank = frequent[by], rank[by]

    def sort(self, s: np.ndarray) -> np.ndarray:
        """A set in the global order; ``s`` is sorted by hash."""
        if not len(self.tokens) or not len(s):
            return s
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        rank = np.where(self.tokens[at] == s, self.rank[at], 0)
        return s[np.argsort(rank, kind="stable")] if rank.any() else s


# ------------------------------------------------------------------ reading texts

def _sets(col: pa.Array):
    for words in word_slices(col, fold=True):
        for d, s in enumerate(shingle_sets(words, SHINGLE)):
            yield words.first + d, s


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each bucket, two buckets a byte."""
    buckets = 1 << max(3, (len(s) - 1).bit_length() - 1)
    while True:
        counts = np.bincount((s & U(buckets - 1)).astype(np.int64), minlength=buckets)
        if counts.max(initial=0) < 16:
            break
        buckets *= 2
    return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()


def overlap_bound(x: bytes, y: bytes) -> int:
    """No less than the intersection of two sets with these sketches."""
    counts = []
    for blob in (x, y):
        pairs = np.frombuffer(blob, np.uint8)
        c = np.empty(2 * len(pairs), np.int64)
        c[::2], c[1::2] = pairs & 15, pairs >> 4
        counts.append(c)
    small = min(map(len, counts))
    a, b = (c.reshape(-1, small).sum(axis=0) for c in counts)
    return int(np.minimum(a, b).sum())


SCAN = "kind int, a long, b long, n long, sketch binary"


def _scan(batches):
    """Kind 0: (doc_id, set hash, size) of each document; kind 1: (shingle, -, count) of frequent ones."""
    held: list[np.ndarray] = []
    size = 0

    def frequent():
        if not held:
            return None
        s = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        n = np.diff(np.append(first, len(s)))
        many = np.flatnonzero(n >= 3)
        if len(many) > LOCAL_TOP:
            many = many[np.argpartition(n[many], len(many) - LOCAL_TOP)[-LOCAL_TOP:]]
        return _rows(1, s[first[many]].view(np.int64), np.zeros(len(many), np.int64), n[many])

    for b in batches:
        ids = b.column(0)
        hashes, sizes = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        sketches: list[bytes | None] = [None] * len(ids)
        for d, s in _sets(b.column(1)):
            sizes[d] = len(s)
            if len(s):
                hashes[d] = set_hash(s)
                sketches[d] = sketch(s)
                held.append(s)
                size += len(s)
        yield _rows(0, ids, hashes, sizes, sketches)
        if size >= COUNT_AT:
            yield frequent()
            held.clear()
            size = 0
    if (rest := frequent()) is not None:
        yield rest


def _rows(kind: int, a, b, n, sketches=None) -> pa.RecordBatch:
    a = a if isinstance(a, pa.Array) else pa.array(a, pa.int64())
    return pa.RecordBatch.from_pydict({"kind": np.full(len(a), kind, np.int32), "a": a,
                                       "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64()),
                                       "sketch": pa.array(sketches or [None] * len(a), pa.binary())})


def _postings(order, num: int, den: int):
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            tokens, heads, sizes, lengths = [], [], [], []
            for _, s in _sets(b.column(0)):
                if not len(s) or (h := set_hash(s)) in seen:        # copies within a task
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(h)
                p = prefix_length(len(s), num, den)
                tokens.append(order.value.sort(s)[:p])
                heads.append(h)
                sizes.append(len(s))
                lengths.append(p)
            if tokens:
                lengths = np.array(lengths)
                starts = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_pydict({
                    "token": np.concatenate(tokens).view(np.int64), "node": np.repeat(np.array(heads, np.int64), lengths),
                    "n": np.repeat(np.array(sizes, np.int32), lengths),
                    "pos": (np.arange(int(lengths.sum())) - np.repeat(starts, lengths)).astype(np.int32)})
    return run


# --------------------------------------------------------------------- candidates

def _within(n1, p1, n2, p2, num: int, den: int):
    """Whether sets of these sizes can link if the shingle at these places is their first common one."""
    return np.minimum(n1 - p1, n2 - p2) >= needed(n1, n2, num, den)


PAIRS = "kind int, token long, a long, b long, n int, pos int"


def _pair_rows(a, b) -> pa.RecordBatch:
    z = np.zeros(len(a), np.int64)
    return pa.RecordBatch.from_pydict({"kind": z.astype(np.int32), "token": z, "a": a, "b": b, "n": z.astype(np.int32),
                                       "pos": z.astype(np.int32)})


def _candidates(num: int, den: int):
    """Pairs (kind 0) of postings that come sorted by shingle, place and set; members of large groups (kind 1)."""
    def run(batches):
        held = None                     # the group that the last batch may not have ended
        pivot = None                    # of a large group: (token, node, n, pos)
        made: set[tuple[int, int]] = set()
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            yield from groups(cols, False, made, pivot_box := [pivot])
            pivot, held = pivot_box[0], pivot_box[1] if len(pivot_box) > 1 else None
            if len(made) > 200_000:
                yield flush(made)
        if held is not None:
            yield from groups(held, True, made, [pivot])
        if made:
            yield flush(made)

    def flush(made):
        a = np.array(list(made), np.int64)
        made.clear()
        return _pair_rows(a[:, 0], a[:, 1])

    def add(made, x, y):
        low, high = np.minimum(x, y), np.maximum(x, y)
        made.update(zip(low.tolist(), high.tolist()))

    def star(made, pivot, node, n, pos):
        ok = (node != pivot[1]) & _within(n.astype(np.int64), pos.astype(np.int64), pivot[2], pivot[3], num, den)
        add(made, np.full(int(ok.sum()), pivot[1]), node[ok])

    def members(token, node, n, pos):
        k = len(node)
        return pa.RecordBatch.from_pydict({"kind": np.ones(k, np.int32), "token": np.full(k, token), "a": node,
                                           "b": np.zeros(k, np.int64), "n": n, "pos": pos})

    def groups(cols, last, made, box):
        token, node, n, pos = cols
        if not len(token):
            return
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])   # copies of other tasks
        token, node, n, pos = (x[fresh] for x in (token, node, n, pos))
        cut = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
        size = np.diff(cut)
        whole = np.ones(len(size), bool)
        if not last:
            whole[-1] = False
        pivot = box[0]
        # two sets: most groups that are no single set
        two = cut[:-1][(size == 2) & whole]
        if pivot is not None and len(two) and two[0] == 0 and token[0] == pivot[0]:
            two = two[1:]
        if len(two):
            ok = _within(n[two].astype(np.int64), pos[two].astype(np.int64), n[two + 1].astype(np.int64), pos[two + 1].astype(np.int64), num, den)
            add(made, node[two[ok]], node[two[ok] + 1])
        for g in np.flatnonzero((size > 2) | ~whole | ((np.arange(len(size)) == 0) & (pivot is not None))).tolist():
            lo, hi = int(cut[g]), int(cut[g + 1])
            t, gn, gs, gp = token[lo], node[lo:hi], n[lo:hi], pos[lo:hi]
            if pivot is not None and pivot[0] == t:                 # a large group goes on
                star(made, pivot, gn, gs, gp)
                yield members(t, gn, gs, gp)
                if whole[g]:
                    pivot = None
                continue
            pivot = None
            if hi - lo > SMALL_GROUP:
                pivot = (t, int(gn[0]), int(gs[0]), int(gp[0]))
                star(made, pivot, gn, gs, gp)
                yield members(t, gn, gs, gp)
                if whole[g]:
                    pivot = None
            elif whole[g]:
                i, j = np.triu_indices(hi - lo, 1)
                s, p = gs.astype(np.int64), gp.astype(np.int64)
                ok = _within(s[i], p[i], s[j], p[j], num, den)
                add(made, gn[i[ok]], gn[j[ok]])
            else:
                box.append([token[lo:hi], gn, gs, gp])
        box[0] = pivot
    return run


def _cross(num: int, den: int):
    """Pairs across components of groups that come sorted by shingle: token, node, n, pos, root."""
    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(5)]
            cols = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols)]
            start = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
            yield from pairs([c[:start] for c in cols])
            held = [c[start:] for c in cols]
        if held is not None:
            yield from pairs(held)

    def pairs(cols):
        token, node, n, pos, root = cols
        cut = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]]) if len(token) else [0]
        for lo, hi in zip(cut[:-1], cut[1:]):
            s, p = n[lo:hi].astype(np.int64), pos[lo:hi].astype(np.int64)
            for k in range(hi - lo - 1):
                rest = slice(lo + k + 1, hi)
                ok = (root[rest] != root[lo + k]) & _within(s[k + 1:], p[k + 1:], s[k], p[k], num, den)
                if ok.any():
                    other = node[rest][ok]
                    me = np.full(len(other), node[lo + k])
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(me, other), "b": np.maximum(me, other)})
    return run


# ------------------------------------------------------------------- prefix trees

class PrefixTree:
    """Sets as the paths of a prefix tree, in depth-first order."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        self.sets = sorted(sets, key=lambda x: x[1].astype(">u8").tobytes())
        self.depth = [0]                    # at which each path leaves the one before
        for (_, a), (_, b) in zip(self.sets, self.sets[1:]):
            m = min(len(a), len(b))
            off = np.flatnonzero(a[:m] != b[:m])
            self.depth.append(int(off[0]) if len(off) else m)

    def linked(self, probe: np.ndarray, num: int, den: int, step: int = 64):
        """The keys of the sets that link with ``probe`` (sorted by hash)."""
        n = len(probe)
        # common[i]: shingles of the path's first i that the probe has, known up to ``known``
        common = np.zeros(max((len(s) for _, s in self.sets), default=0) + 1, np.int64)
        known = 0
        for (key, path), depth in zip(self.sets, self.depth):
            known = min(known, depth)
            m, want = len(path), needed(n, len(path), num, den)
            while True:
                have = int(common[known])
                # what is left of the path, and of the probe
                if have + min(m - known, n - have) < want or known == m:
                    break
                to = min(known + step, m)
                part = path[known:to]
                at = np.searchsorted(probe, part)
                hit = probe[np.minimum(at, n - 1)] == part
                common[known + 1:to + 1] = have + np.cumsum(hit)
                known = to
            if known == m and int(common[m]) >= want:
                yield key


def _verify(num: int, den: int):
    """Links among rows (a, tree, flag, node, set) that come sorted by a, tree and flag: flag 0 has a's own set."""
    def run(batches):
        key, probe, sets, out = None, None, [], []

        def end():
            if probe is not None and sets:
                own = np.sort(probe)
                out.extend((key[0], b) for b in PrefixTree(sets).linked(own, num, den))

        for b in batches:
            a, tree, flag, node, blob = (b.column(i).to_pylist() for i in range(5))
            for k in range(len(a)):
                if (a[k], tree[k]) != key:
                    end()
                    key, probe, sets = (a[k], tree[k]), None, []
                s = np.frombuffer(blob[k], np.uint64)
                if flag[k]:
                    sets.append((node[k], s))
                else:
                    probe = s
            if len(out) > 10_000:
                yield links(out)
        end()
        if out:
            yield links(out)

    def links(out):
        a = np.array(out, np.int64)
        out.clear()
        return pa.RecordBatch.from_pydict({"u": a[:, 0], "v": a[:, 1]})
    return run


def _possible(num: int, den: int):
    """The pairs (a, b) whose sketches leave room for a link."""
    def run(batches):
        for b in batches:
            x, y, na, nb, sa, sb = (b.column(i).to_pylist() for i in range(6))
            ok = [overlap_bound(sa[k], sb[k]) >= needed(na[k], nb[k], num, den) for k in range(len(x))]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
    return run


def _tree_rows(order):
    """(a, tree, flag, node, set) of texts with the list of trees that their sets go to."""
    def run(batches):
        for b in batches:
            goals = b.column(1).to_pylist()
            rows = []
            for d, s in _sets(b.column(0)):
                if not len(s):
                    continue
                node, blob = set_hash(s), None
                for g in goals[d]:
                    if g["node"] == node:           # not another text of the same id
                        if blob is None:            # frequent first
                            blob = np.ascontiguousarray(order.value.sort(s)[::-1]).tobytes()
                        rows.append((g["a"], g["tree"], g["flag"], node, blob))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["a", "tree", "flag", "node", "set"])
    return run


def _links(edges: DataFrame, docs: DataFrame, first: DataFrame, order, num: int, den: int) -> DataFrame:
    """The (a, b) edges whose sets link, as saved (u, v)."""
    x, y = (first.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    possible = (edges.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb")
                .mapInArrow(_possible(num, den), "a long, b long"))
    possible = save(possible, "join-possible")
    # the end with more pairs holds the tree, so that it travels once a tree
    degree = (possible.select(F.col("a").alias("node")).unionByName(possible.select(F.col("b").alias("node")))
              .groupBy("node").agg(F.count(F.lit(1)).alias("d")))
    pairs = (possible.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a")
             .join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b"))
    turn = F.col("db") > F.col("da")
    pairs = pairs.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"),
                         F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    dealt = save(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / TREE_SETS))
                                              .cast("int").alias("tree")), "join-trees")
    goals = (dealt.select(F.col("b").alias("node"), "a", "tree", F.lit(1).alias("flag"))
             .unionByName(dealt.select(F.col("a").alias("node"), "a", "tree", F.lit(0).alias("flag")).distinct()))
    wanted = (goals.join(first.select("node", "doc"), "node")
              .groupBy("doc").agg(F.collect_list(F.struct("node", "a", "tree", "flag")).alias("goals")))
    wanted = save(wanted.select(F.col("doc").alias("wanted"), "goals"), "join-wanted")
    size = wanted.agg(F.sum(F.size("goals") * 32 + 16)).first()[0] or 0
    texts = docs.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, F.col("doc") == F.col("wanted"))
    rows = (texts.select("text", "goals").mapInArrow(tidy(_tree_rows(order)), "a long, tree int, flag int, node long, set binary")
            .repartition("a", "tree").sortWithinPartitions("a", "tree", "flag"))
    return save(rows.mapInArrow(_verify(num, den), "u long, v long"), "join-links")


# ----------------------------------------------------------------------- the join

def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; ``threshold`` is a fraction."""
    ship(docs.sparkSession)
    num, den = threshold
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    scan = save(docs.mapInArrow(tidy(_scan), SCAN), "join-scan")
    rows = scan.where("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("node"), F.col("n"))
    first = save(scan.where("kind = 0 AND n > 0 AND a IS NOT NULL").groupBy(F.col("b").alias("node"))
                 .agg(F.min("a").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "join-sets")
    top = (scan.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "a").limit(FREQUENT).collect())        # FREQUENT rows at most
    frequent = np.array([r.a for r in reversed(top)], np.int64).view(np.uint64)
    order = docs.sparkSession.sparkContext.broadcast(Order(frequent))

    known = docs.where(F.col("doc").isNotNull())
    postings = (known.select("text").mapInArrow(tidy(_postings(order, num, den)), "token long, node long, n int, pos int")
                .repartition("token").sortWithinPartitions("token", "pos", "node"))
    found = save(postings.mapInArrow(tidy(_candidates(num, den)), PAIRS), "join-candidates")
    edges = save(found.where("kind = 0").select("a", "b").distinct(), "join-edges")
    links = _links(edges, known, first, order, num, den)
    roots = save(components(links), "join-roots")

    # large groups that lie in several components
    large = (found.where("kind = 1").select("token", F.col("a").alias("node"), "n", "pos")
             .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    split = large.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    cross = (large.join(split, "token").select("token", "node", "n", "pos", "root")
             .repartition("token").sortWithinPartitions("token", "pos", "node")
             .mapInArrow(_cross(num, den), "a long, b long").distinct()
             .join(edges, ["a", "b"], "left_anti"))
    more = save(cross, "join-cross")
    if more.limit(1).count():
        links = links.unionByName(_links(more, known, first, order, num, den))
        roots = save(components(links), "join-roots")

    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = (F.col("n") > 0) & F.col("doc").isNotNull()
    least = placed.where(linked).groupBy("root").agg(F.min("doc").alias("component"))
    out = placed.join(least, "root", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(linked, F.col("component")).otherwise(F.col("doc")).alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


OP3_SQL = r"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
                               ELSE concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(u, v) AS (
  SELECT doc_id, doc_id FROM texts
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id JOIN least l ON l.u = t.doc_id
"""
