"""Random forests (ML10, ML12) whose rows take some ten bytes each while they are fitted.

``pyspark.ml`` keeps a bag count and a node number for every row and tree (some 1400
bytes a row for a hundred trees) and reads them again at every level. Here:

1. every feature is cut into at most ``BINS`` bins: between all its values when they are
   few, else at quantiles over all rows. A row is then one byte a feature and its label;
   some 200,000 rows make one packed block, and only the blocks are cached;
2. a row's count in a tree's bag (Poisson with mean 1) is drawn anew whenever it is
   needed, from a generator seeded by the block's bytes and the tree, so it is never stored;
3. when the bins of all features make a small grid (``CELLS``), a block's rows are added
   up per cell and tree in one pass, and each tree is grown in a task from its cells;
4. otherwise the trees grow level by level: tasks walk their rows down the trees and
   count them per node, feature and bin, for as many trees at a time as ``COUNT_BYTES``
   holds; the counts are added up and split in tasks, and only the splits reach the driver.

Both ways give the same trees. The result is a ``pyspark.ml`` model, made through its
saved form.
"""

from __future__ import annotations

import json
import math
import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.session import scratch_path, ship_package

BINS = 128                      # bins of a feature
BLOCK_ROWS = 1 << 18            # rows of a packed block
CELLS = 1 << 15                 # largest grid that is added up per cell
COUNT_BYTES = 64 << 20          # counts that a task holds at a time
ENTRY_BYTES = 1 << 20           # counts that travel as one row
QUANTILE_ACCURACY = 10_000
LEAST_GAIN = 1e-12              # of the root's impurity: less is rounding

BLOCKS = "n int, bins binary, labels binary"
COUNTS = "tree int, lo int, width int, counts binary"
SPLITS = ("tree int, node int, feature int, bin int, gain double, total array<double>, left array<double>, "
          "right array<double>")
TREES = ("tree int, feature array<int>, bin array<int>, gain array<double>, left array<int>, right array<int>, "
         "stats array<double>")


# ------------------------------------------------------------------- tree arrays

@dataclass(frozen=True)
class Shape:
    """What all trees of a forest share. ``classes`` is 0 for numbers, whose statistics
    are count, sum and sum of squares; else they are the classes' counts."""
    features: int
    slots: int                  # features that a node may choose from
    bins: int
    classes: int
    depth: int
    seed: int
    least: float = LEAST_GAIN

    @property
    def stats(self) -> int:
        return self.classes or 3

    @property
    def count_type(self):
        return np.uint32 if self.classes else np.float64

    @property
    def node_bytes(self) -> int:
        return self.slots * self.bins * self.stats * np.dtype(self.count_type).itemsize

    def counts(self, nodes: int) -> np.ndarray:
        return np.zeros(nodes * self.slots * self.bins * self.stats, self.count_type)


def _bag_table() -> np.ndarray:
    """Poisson(1) counts by a 16-bit number: each count has its probability's share of the numbers."""
    p, ends, total = math.exp(-1), [], 0.0
    for k in range(12):
        total += p
        ends.append(round(total * 65536))
        p /= k + 1
    return np.searchsorted(np.array(ends), np.arange(65536), side="right").astype(np.uint8)


BAG = _bag_table()


def bag(seed: int, key: tuple, tree: int, n: int) -> np.ndarray:
    """How often each row of a block is in a tree's bag."""
    rng = np.random.Generator(np.random.SFC64([seed, *key, tree]))
    return BAG[rng.integers(0, 65536, n, dtype=np.uint16)]


def choices(s: Shape, tree: int, level: int, nodes: int) -> np.ndarray:
    """The features, in order, that each node of a level may choose from."""
    if s.slots == s.features:
        return np.broadcast_to(np.arange(s.features), (nodes, s.features))
    rng = np.random.default_rng([s.seed, tree, level])
    return np.sort(rng.random((nodes, s.features)).argsort(axis=1)[:, :s.slots], axis=1)


def impurity(s: Shape, stats: np.ndarray) -> np.ndarray:
    """Gini or variance of statistics (last axis)."""
    if s.classes:
        n = np.maximum(stats.sum(-1), 1e-300)
        return 1.0 - ((stats / n[..., None]) ** 2).sum(-1)
    n = np.maximum(stats[..., 0], 1e-300)
    return np.maximum(stats[..., 2] / n - (stats[..., 1] / n) ** 2, 0.0)


def _weight(s: Shape, stats: np.ndarray) -> np.ndarray:
    return stats.sum(-1) if s.classes else stats[..., 0]


def best_splits(s: Shape, counts: np.ndarray, chosen: np.ndarray) -> tuple:
    """(feature or -1, bin, gain, total, left, right) of nodes by their counts
    (node, slot, bin, statistic): the first highest gain; a row goes left up to the bin."""
    cum = np.ascontiguousarray(np.moveaxis(counts, -1, 0), dtype=np.float64).cumsum(axis=-1)      # statistics first
    total, left = cum[:, :, 0, -1], cum[..., :-1]
    right = total[:, :, None, None] - left
    n, nl, nr = (x.sum(axis=0) if s.classes else x[0] for x in (total, left, right))
    of = slice(None) if s.classes else slice(1, 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[of] ** 2).sum(axis=0) / nl + (right[of] ** 2).sum(axis=0) / nr
        gain = (gain - ((total[of] ** 2).sum(axis=0) / n)[:, None, None]) / n[:, None, None]
    gain = np.where((nl > 0) & (nr > 0), gain, -np.inf)
    m = len(counts)
    flat = gain.reshape(m, -1)
    if not flat.shape[1]:                       # every feature has one bin
        zero = np.zeros_like(total.T)
        return np.full(m, -1), np.zeros(m, int), np.zeros(m), total.T, zero, zero
    # gains that differ by rounding alone count as equal, so the way of adding up chooses no split
    top = flat.max(axis=1)
    at = (flat >= np.where(top > 0, top * (1 - 1e-9), top)[:, None]).argmax(axis=1)
    slot, split = np.divmod(at, gain.shape[2])
    rows = np.arange(m)
    won = top > s.least
    return (np.where(won, chosen[rows, slot], -1), split, np.where(won, top, 0.0), total.T,
            left[:, rows, slot, split].T, right[:, rows, slot, split].T)


@dataclass
class Tree:
    """A growing tree: its nodes, parents first, and by level what is needed to walk rows down."""
    shape: Shape
    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    stats: list = field(default_factory=list)
    levels: list = field(default_factory=list)      # (feature, bin, next): next of 2 * node + side, -1 at a leaf
    open: list = field(default_factory=lambda: [None])      # nodes of the next level to split

    def _add(self, stats) -> int:
        self.feature.append(-1)
        self.bin.append(-1)
        self.gain.append(-1.0)
        self.left.append(-1)
        self.right.append(-1)
        self.stats.append(stats)
        return len(self.feature) - 1

    def take(self, feature, split, gain, total, left, right) -> None:
        """The splits of the open nodes, in order; their children become the open nodes."""
        m = len(self.open)
        if self.open == [None]:
            self.open = [self._add(total[0])]
        can = len(self.levels) + 1 < self.shape.depth
        splits = (feature >= 0) & (self.shape.depth > 0)
        goes = [can & (impurity(self.shape, x) > self.shape.least) for x in (left, right)]
        nxt, opened = np.full(2 * m, -1, np.int64), []
        for a in np.flatnonzero(splits):
            at = self.open[a]
            self.feature[at], self.bin[at], self.gain[at] = int(feature[a]), int(split[a]), float(gain[a])
            for side, stats in enumerate((left, right)):
                child = self._add(stats[a])
                (self.right if side else self.left)[at] = child
                if goes[side][a]:
                    nxt[2 * a + side] = len(opened)
                    opened.append(child)
        self.levels.append((np.where(splits, feature, 0).astype(np.int64), split.astype(np.uint8), nxt))
        self.open = opened


def walk(levels: list, flat: np.ndarray, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the rows ``at`` that reach an open node, the number of that node); ``flat`` holds a
    block's bins, feature by feature. Rows in a leaf go on to a place behind a level's nodes."""
    node = np.zeros(len(at), np.int64)
    for i, (feature, split, nxt) in enumerate(levels):
        gone = len(levels[i + 1][0]) if i + 1 < len(levels) else -1
        nxt = np.append(np.where(nxt < 0, gone, nxt), [gone, gone])
        right = flat.take(np.append(feature * n, 0).take(node) + at) > np.append(split, split[:1]).take(node)
        node += node
        node += right
        node = nxt.take(node)
    if not levels or levels[-1][2].min() >= 0 and all(x[2].min() >= 0 for x in levels):
        return at, node
    stay = np.flatnonzero(node >= 0)
    return at[stay], node[stay]


def add_up(s: Shape, counts: np.ndarray, flat: np.ndarray, n: int, at: np.ndarray, node: np.ndarray, lo: int,
           chosen: np.ndarray, weights: list) -> None:
    """Rows ``at``, in nodes ``lo`` and on, added to ``counts`` (node, slot, bin, statistic). Classes come as
    (label, count) and numbers as the statistics."""
    nodes = len(counts) // (s.slots * s.bins * s.stats)
    by_slot = counts.reshape(nodes, s.slots, s.bins, s.stats)
    first = (node - lo) * s.bins
    for slot in range(s.slots):
        cell = flat[(chosen[:, slot] * n)[node] + at] + first
        if s.classes:
            got = np.bincount(cell * s.classes + weights[0], weights[1], nodes * s.bins * s.classes)
            by_slot[:, slot] += got.reshape(nodes, s.bins, s.classes).astype(counts.dtype)
        else:
            for i, w in enumerate(weights):
                by_slot[:, slot, :, i] += np.bincount(cell, w, nodes * s.bins).reshape(nodes, s.bins)


def ranges(s: Shape, nodes: int, most: int) -> Iterator[tuple[int, int]]:
    """The nodes of a level in ranges whose counts take ``most`` bytes."""
    step = max(1, most // s.node_bytes)
    for lo in range(0, nodes, step):
        yield lo, min(nodes, lo + step)


# ------------------------------------------------------------------------- tasks

def _few_values(most: int):
    def run(batches):
        seen = None
        for b in batches:
            x = _matrix(b.column(0))
            seen = seen or [np.empty(0)] * x.shape[1]
            for f, have in enumerate(seen):
                if have is not None:
                    have = np.unique(np.concatenate([have, x[:, f]]))
                    seen[f] = have if len(have) <= most else None
        if seen is not None:
            yield pa.RecordBatch.from_pydict({"feature": pa.array(range(len(seen)), pa.int32()),
                                              "few": pa.array([None if v is None else v.tolist() for v in seen],
                                                              pa.list_(pa.float64()))})
    return run


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _packer(edges: list, classes: int, mean: float):
    """Rows -> blocks: the bins feature by feature, rows alike together, and the labels."""
    label_type = np.float64 if not classes else np.uint8 if classes <= 256 else np.int32

    def pack(held):
        bins, labels = np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held])
        order = np.lexsort((labels, *bins[::-1]))       # the same bytes, and bags, in whatever order the rows came
        return pa.RecordBatch.from_pydict({"n": pa.array([len(labels)], pa.int32()),
                                           "bins": pa.array([bins[:, order].tobytes()], pa.binary()),
                                           "labels": pa.array([labels[order].tobytes()], pa.binary())})

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            held.append((np.stack([np.searchsorted(e, x[:, f], side="left").astype(np.uint8)
                                   for f, e in enumerate(edges)]),
                         (y if classes else y - mean).astype(label_type)))
            rows += len(y)
            if rows >= BLOCK_ROWS:
                yield pack(held)
                held, rows = [], 0
        if rows:
            yield pack(held)
    return run, label_type


def _blocks(batches):
    """(key, rows, bins, labels) of the blocks in Arrow batches."""
    for b in batches:
        for i in range(b.num_rows):
            bins, labels = b.column(1)[i].as_buffer(), b.column(2)[i].as_buffer()
            yield (zlib.crc32(bins), zlib.crc32(labels)), b.column(0)[i].as_py(), np.frombuffer(bins, np.uint8), labels


def _counts_row(s: Shape, tree: int, lo: int, counts: np.ndarray) -> pa.RecordBatch:
    """Counts of one task; those of classes are whole numbers, of as many bytes as the largest needs."""
    data = counts.astype(np.min_scalar_type(int(counts.max(initial=0)))) if s.classes else counts
    return pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "lo": pa.array([lo], pa.int32()),
                                       "width": pa.array([data.itemsize], pa.int32()), "counts": pa.array([data.tobytes()], pa.binary())})


def _added(s: Shape, table: pa.Table) -> np.ndarray:
    """The sum of the counts in a group's rows."""
    out = 0.0
    for width, c in zip(table.column("width").to_pylist(), table.column("counts")):
        out = out + np.frombuffer(c.as_buffer(), f"u{width}" if s.classes else np.float64)
    return out


def _count_cells(s: Shape, sizes: list[int], trees: int, label_type):
    """Blocks -> each tree's statistics by cell of the grid of bins."""
    strides = np.array([math.prod(sizes[f + 1:]) for f in range(s.features)], np.int64)

    def run(batches):
        sums = np.zeros((trees, math.prod(sizes) * s.stats))
        any_rows = False
        for key, n, flat, labels in _blocks(batches):
            any_rows = True
            cell = strides @ flat.reshape(s.features, n).astype(np.int64)
            y = np.frombuffer(labels, label_type)
            if s.classes:
                order = np.lexsort((y, cell))       # a row's bag count stays with the row
                cell = cell * s.classes + y
                cell = cell[order]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            keys = cell[starts]
            for t in range(trees):
                w = bag(s.seed, key, t, n)
                if s.classes:
                    sums[t, keys] += np.add.reduceat(w[order], starts, dtype=np.int64)
                else:
                    wy = w * y
                    sums[t, keys * 3] += np.add.reduceat(w, starts, dtype=np.int64)
                    sums[t, keys * 3 + 1] += np.add.reduceat(wy, starts)
                    sums[t, keys * 3 + 2] += np.add.reduceat(wy * y, starts)
        if any_rows:
            for t in range(trees):
                yield _counts_row(s, t, 0, sums[t])
    return run


def _grow_from_cells(s: Shape, sizes: list[int]):
    """A tree's statistics by cell -> the tree."""
    def run(table: pa.Table) -> pa.Table:
        number = table.column("tree")[0].as_py()
        tree = grow_cells(s, sizes, number, _added(s, table))
        return pa.table({"tree": pa.array([number], pa.int32()), "feature": pa.array([tree.feature], pa.list_(pa.int32())),
                         "bin": pa.array([tree.bin], pa.list_(pa.int32())),
                         "gain": pa.array([tree.gain], pa.list_(pa.float64())),
                         "left": pa.array([tree.left], pa.list_(pa.int32())),
                         "right": pa.array([tree.right], pa.list_(pa.int32())),
                         "stats": pa.array([np.concatenate(tree.stats)], pa.list_(pa.float64()))})
    return run


def grow_cells(s: Shape, sizes: list[int], number: int, sums: np.ndarray) -> Tree:
    sums = sums.reshape(-1, s.stats)
    used = np.flatnonzero(_weight(s, sums) > 0)
    sums, n = sums[used], len(used)
    flat = np.concatenate([b.astype(np.uint8) for b in np.unravel_index(used, sizes)])
    tree, every = Tree(s), np.arange(n)
    while tree.open:
        m, level = len(tree.open), len(tree.levels)
        at, node = walk(tree.levels, flat, n, every)
        chosen, found = choices(s, number, level, m), []
        for lo, hi in ranges(s, m, COUNT_BYTES):
            counts = s.counts(hi - lo)
            here = slice(None) if (lo, hi) == (0, m) else (node >= lo) & (node < hi)
            a, b = at[here], node[here]
            if s.classes:
                for k in range(s.classes):
                    add_up(s, counts, flat, n, a, b, lo, chosen, [k, sums[a, k]])
            else:
                add_up(s, counts, flat, n, a, b, lo, chosen, [sums[a, i] for i in range(3)])
            found.append(best_splits(s, counts.reshape(hi - lo, s.slots, s.bins, s.stats), chosen[lo:hi]))
        tree.take(*[np.concatenate(x) for x in zip(*found)])
    return tree


def _count_level(s: Shape, work, label_type):
    """Blocks -> counts of the open nodes of some trees: ``work`` holds (tree, levels, open nodes, (lo, hi))."""
    def run(batches):
        entries = [(t, levels, lo, hi, choices(s, t, len(levels), m), s.counts(hi - lo))
                   for t, levels, m, parts in work.value for lo, hi in parts]
        any_rows = False
        for key, n, flat, labels in _blocks(batches):
            any_rows = True
            y = np.frombuffer(labels, label_type)
            before = None
            for t, levels, lo, hi, chosen, counts in entries:
                if t != before:
                    w = bag(s.seed, key, t, n)
                    at, node = walk(levels, flat, n, np.flatnonzero(w.astype(bool)))
                    before = t
                here = slice(None) if (lo, hi) == (0, len(chosen)) else np.flatnonzero((node >= lo) & (node < hi))
                a = at[here]
                wa, ya = w[a].astype(np.float64), y[a]
                add_up(s, counts, flat, n, a, node[here], lo, chosen,
                       [ya, wa] if s.classes else [wa, wa * ya, wa * ya * ya])
        if any_rows:
            for t, _, lo, _, _, counts in entries:
                yield _counts_row(s, t, lo, counts)
    return run


def _split_level(s: Shape, level: int, open_nodes: dict):
    """Counts of a range of nodes -> their splits."""
    def run(table: pa.Table) -> pa.Table:
        t, lo = table.column("tree")[0].as_py(), table.column("lo")[0].as_py()
        counts = _added(s, table).reshape(-1, s.slots, s.bins, s.stats)
        chosen = choices(s, t, level, open_nodes[t])[lo:lo + len(counts)]
        feature, split, gain, total, left, right = best_splits(s, counts, chosen)
        m = len(feature)
        return pa.table({"tree": pa.array([t] * m, pa.int32()), "node": pa.array(range(lo, lo + m), pa.int32()),
                         "feature": pa.array(feature, pa.int32()), "bin": pa.array(split, pa.int32()),
                         "gain": pa.array(gain, pa.float64()),
                         **{k: pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * s.stats,
                                                        np.ascontiguousarray(v, dtype=np.float64).ravel())
                            for k, v in (("total", total), ("left", left), ("right", right))}})
    return run


# ----------------------------------------------------------------------- fitting

class Forest:
    """An estimator: ``fit(rows)`` with the columns ``features`` and ``label`` gives a ``pyspark.ml`` forest."""

    def __init__(self, classify: bool, trees: int, depth: int, seed: int):
        self.classify, self.trees, self.depth, self.seed = classify, trees, depth, seed

    def fit(self, rows: DataFrame):
        spark = rows.sparkSession
        ship_package(spark)
        x = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        edges, highest, mean, var = bin_edges(x)
        classes = 0
        if self.classify:
            attr = rows.schema["label"].metadata.get("ml_attr", {})
            classes = max(int(attr.get("num_vals", 0)), int(highest) + 1, 2)
        d = len(edges)
        s = Shape(d, math.ceil(math.sqrt(d)) if self.classify else d, max(len(e) + 1 for e in edges), classes,
                  self.depth, self.seed, LEAST_GAIN if self.classify else LEAST_GAIN * max(var, 1e-300))
        pack, label_type = _packer(edges, classes, mean)
        blocks = x.mapInArrow(pack, BLOCKS).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sizes = [len(e) + 1 for e in edges]
            if math.prod(sizes) * s.stats <= CELLS * 3:
                trees = self._grow_cells(spark, blocks, s, sizes, label_type)
            else:
                trees = self._grow_levels(spark, blocks, s, label_type)
        finally:
            blocks.unpersist()
        return self._model(spark, trees, s, edges, mean)

    def _tasks(self, spark, blocks: DataFrame) -> DataFrame:
        """A task a core: its counts are as large for few rows as for many."""
        return blocks.coalesce(spark.sparkContext.defaultParallelism)

    def _grow_cells(self, spark, blocks, s, sizes, label_type) -> list[Tree]:
        sums = self._tasks(spark, blocks).mapInArrow(_count_cells(s, sizes, self.trees, label_type), COUNTS)
        grown = (sums.repartition(spark.sparkContext.defaultParallelism, "tree").groupBy("tree")
                 .applyInArrow(_grow_from_cells(s, sizes), TREES))
        got = grown.toArrow().sort_by("tree")
        return [Tree(s, *[got.column(c)[i].values.to_numpy() for c in ("feature", "bin", "gain", "left", "right")],
                     got.column("stats")[i].values.to_numpy().reshape(-1, s.stats)) for i in range(got.num_rows)]

    def _grow_levels(self, spark, blocks, s, label_type) -> list[Tree]:
        trees = [Tree(s) for _ in range(self.trees)]
        source, cores = self._tasks(spark, blocks), spark.sparkContext.defaultParallelism
        for level in range(max(1, self.depth)):
            todo = [(t, lo, hi) for t, tree in enumerate(trees) if tree.open
                    for lo, hi in ranges(s, len(tree.open), ENTRY_BYTES)]
            found = {}
            while todo:
                held, work = 0, {}
                while todo and (not work or held + (todo[0][2] - todo[0][1]) * s.node_bytes <= COUNT_BYTES):
                    t, lo, hi = todo.pop(0)
                    held += (hi - lo) * s.node_bytes
                    work.setdefault(t, []).append((lo, hi))
                sent = spark.sparkContext.broadcast([(t, trees[t].levels, len(trees[t].open), parts)
                                                     for t, parts in work.items()])
                counts = source.mapInArrow(_count_level(s, sent, label_type), COUNTS)
                splits = (counts.repartition(cores, "tree", "lo").groupBy("tree", "lo").applyInArrow(
                    _split_level(s, level, {t: len(trees[t].open) for t in work}), SPLITS))
                got = splits.toArrow()
                sent.destroy()
                tree_of, order = got.column("tree").to_numpy(), got.column("node").to_numpy()
                for t in work:
                    mine = np.flatnonzero(tree_of == t)
                    mine = got.take(mine[np.argsort(order[mine])])
                    found.setdefault(t, []).append(
                        [mine.column(c).to_numpy() for c in ("feature", "bin", "gain")]
                        + [_matrix(mine.column(c).combine_chunks()) for c in ("total", "left", "right")])
            if not found:
                break
            for t, got in found.items():
                trees[t].take(*[np.concatenate(c) for c in zip(*got)])
        return trees

    def _model(self, spark, trees: list[Tree], s: Shape, edges: list, mean: float):
        """The trees in the saved form of ``pyspark.ml``, read back by it."""
        path = scratch_path(spark, "forest")
        kind, cls = (("Classification", RandomForestClassificationModel) if s.classes
                     else ("Regression", RandomForestRegressionModel))
        package = f"org.apache.spark.ml.{kind.lower()}"
        facts = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        shared = {"cacheNodeIds": False, "checkpointInterval": 10, "featuresCol": "features",
                  "impurity": "gini" if s.classes else "variance", "labelCol": "label", "leafCol": "", "maxBins": 32,
                  "maxDepth": 5, "maxMemoryInMB": 256, "minInfoGain": 0.0, "minInstancesPerNode": 1,
                  "minWeightFractionPerNode": 0.0, "predictionCol": "prediction", "seed": self.seed}
        if s.classes:
            shared |= {"probabilityCol": "probability", "rawPredictionCol": "rawPrediction"}
        top = {"class": f"{package}.RandomForest{kind}Model", **facts, "uid": f"RandomForest_{os.path.basename(path)[-12:]}",
               "paramMap": {"maxBins": BINS, "maxDepth": self.depth, "numTrees": len(trees),
                            "featureSubsetStrategy": "sqrt" if s.classes else "all"},
               "defaultParamMap": shared | {"bootstrap": True, "featureSubsetStrategy": "auto", "numTrees": 20,
                                            "subsamplingRate": 1.0},
               "numFeatures": s.features, "numTrees": len(trees)} | ({"numClasses": s.classes} if s.classes else {})
        one = {"class": f"{package}.DecisionTree{kind}Model", **facts,
               "paramMap": {"maxBins": BINS, "maxDepth": self.depth}, "defaultParamMap": shared}
        spark.createDataFrame([(json.dumps(top),)], "value string").coalesce(1).write.text(os.path.join(path, "metadata"))
        spark.createDataFrame([(t, json.dumps(one | {"uid": f"{top['uid']}_{t}"}), 1.0) for t in range(len(trees))],
                              "_1 int, _2 string, _3 double").coalesce(1).write.parquet(os.path.join(path, "treesMetadata"))
        spark.createDataFrame(_node_table(s, trees, edges, mean)).selectExpr(
            "treeID", "struct(id, prediction, impurity, impurityStats, rawCount, gain, leftChild, rightChild, "
            "struct(featureIndex, leftCategoriesOrThreshold, numCategories) AS split) AS nodeData"
        ).coalesce(1).write.parquet(os.path.join(path, "data"))
        return cls.load(path)


def _node_table(s: Shape, trees: list[Tree], edges: list, mean: float) -> pa.Table:
    """One row a node, as ``pyspark.ml`` saves them."""
    sizes = [len(tree.feature) for tree in trees]
    stats = np.concatenate([np.array(tree.stats).reshape(-1, s.stats) for tree in trees])
    feature, split, left, right = (np.concatenate([np.array(getattr(tree, k), np.int32) for tree in trees])
                                   for k in ("feature", "bin", "left", "right"))
    pure, weight, inner = impurity(s, stats), _weight(s, stats), feature >= 0
    if s.classes:
        said = stats.argmax(axis=1).astype(float)
    else:                           # the labels were packed less their mean
        said = stats[:, 1] / np.maximum(weight, 1e-300) + mean
        stats = np.stack([weight, stats[:, 1] + weight * mean,
                          stats[:, 2] + 2 * mean * stats[:, 1] + weight * mean * mean], axis=1)
    n, edge_at = len(feature), np.cumsum([0, *map(len, edges)])[:-1]
    cuts = np.concatenate(edges)[edge_at[feature[inner]] + split[inner]] if inner.any() else np.empty(0)
    return pa.table({
        "treeID": pa.array(np.repeat(np.arange(len(trees)), sizes), pa.int32()),
        "id": pa.array(np.concatenate([np.arange(k) for k in sizes]), pa.int32()),
        "prediction": said, "impurity": pure,
        "impurityStats": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * s.stats, stats.ravel()),
        "rawCount": pa.array(weight.astype(np.int64)), "gain": np.concatenate([np.array(t.gain, float) for t in trees]),
        "leftChild": left, "rightChild": right, "featureIndex": feature,
        "leftCategoriesOrThreshold": pa.ListArray.from_arrays(np.r_[0, np.cumsum(inner)].astype(np.int32), cuts),
        "numCategories": pa.array([-1] * n, pa.int32())})


def bin_edges(x: DataFrame) -> tuple[list, float, float, float]:
    """(each feature's edges: a row is in bin b when b edges lie below its value; the
    highest label, the labels' mean and variance), over all rows."""
    few: dict = {}
    for r in x.select("x").mapInArrow(_few_values(BINS), "feature int, few array<double>").collect():
        have = few.setdefault(r["feature"], set())
        few[r["feature"]] = None if have is None or r["few"] is None else have | set(r["few"])
    if not few:
        raise ValueError("no rows to fit on")
    few = {f: v if v is not None and len(v) <= BINS else None for f, v in few.items()}
    shares = [i / BINS for i in range(1, BINS)]
    many = [f for f in sorted(few) if few[f] is None]
    got = x.agg(F.max("label"), F.avg("label"), F.var_pop("label"),
                *[F.percentile_approx(F.col("x")[f], shares, QUANTILE_ACCURACY) for f in many]).first()
    cuts = dict(zip(many, got[3:]))
    edges = []
    for f in sorted(few):
        if few[f] is None:
            edges.append(np.unique(np.array(cuts[f], float)))
        else:
            v = np.array(sorted(few[f]))
            edges.append((v[:-1] + v[1:]) / 2)
    return edges, got[0], got[1], got[2]
