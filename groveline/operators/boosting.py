"""Boosted trees grown on binned rows, the fits of all folds of one depth in the same passes.

The trees are those of Spark's ``GBTClassifier``: the same split candidates, sums, gains and
order among equal gains, so on one partition they are equal to the last bit; on more, sums are
added up in another order. Rows are binned once for each fold into a few large blocks of
bytes. Nodes of many rows are split by passes over those, a level of all trees at a time: numpy
gives the sums of a block, other tasks add them up and find the best splits. The rows of a
smaller node meet in one task, which grows all that is below it. Only splits come to the driver.
"""

from __future__ import annotations

import json
import math
import sys
import time
from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.sources.scratch import fresh_path, remove

# Send the code itself to the workers, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bins and nodes are told by bytes and by 16 bits.
MOST_BINS, DEEPEST = 256, 14
# Rows of a block, about, and of a task that grows small nodes; the rows of a small node at most, some
# 60 bytes each; nodes whose gains are held at once.
_BLOCK_ROWS, SMALL, _CHUNK = 1 << 20, 1 << 20, 128
# From so many rows on features are summed together, and so many combinations of their bins at most.
_MANY, _JOINT = 1 << 16, 1 << 12
# Rows that are led on at a time, so that they stay in the processor's cache.
_ROWS = 1 << 14
_EPSILON = 2.0**-52


# --- split candidates --------------------------------------------------------


def thresholds(values: np.ndarray, rows: float, most: int) -> np.ndarray:
    """Where one feature may be split, at ``most`` places, from a sample that stands for ``rows`` sampled rows.

    As in Spark: between all values if those are few, else where the count passes equal strides;
    zeros are what the other values leave of ``rows``.
    """
    at, counts = np.unique(values[values != 0.0], return_counts=True)
    if not len(at):
        return np.empty(0)
    counts = counts.astype("float64")
    seen = float(counts.sum())
    if rows - seen > _EPSILON * seen * 100:
        place = int(np.searchsorted(at, 0.0))
        at, counts = np.insert(at, place, 0.0), np.insert(counts, place, rows - seen)
    between = (at[:-1] + at[1:]) / 2.0
    if len(between) <= most:
        return between
    stride = rows / (most + 1)
    found, so_far, target = [], counts[0], stride
    for i in range(1, len(at)):
        before, so_far = so_far, so_far + counts[i]
        if abs(before - target) < abs(so_far - target):
            found.append(between[i - 1])
            target += stride
    return np.array(found)


def candidates(vectors: DataFrame, rows: int, bins: int, seed: int) -> list[np.ndarray]:
    """For each feature its thresholds, from the sample of rows that Spark's trees draw."""
    spark, bins = vectors.sparkSession, min(bins, rows)
    wanted = max(bins * bins, 10_000)
    fraction = wanted / rows if wanted < rows else 1.0
    narrow = vectors.select(vector_to_array("features").alias("x"))
    if fraction < 1.0:
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = narrow._jdf.toJavaRDD().sample(False, fraction, draw)
        narrow = DataFrame(spark._jsparkSession.createDataFrame(drawn, narrow._jdf.schema()), spark)
    sample = np.array([r.x for r in narrow.collect()])
    return [thresholds(sample[:, f], fraction * rows, bins - 1) for f in range(sample.shape[1])]


# --- blocks ------------------------------------------------------------------


def _alone(rdd: RDD) -> RDD:
    """Every element pickled by itself, so that tables of the same blocks can be zipped."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def blocks(vectors: DataFrame, label: str, fold: str, sets: dict, rows: int) -> RDD:
    """(set, bins by feature and row, labels, and the same of the rows held out), for each set in each partition.

    ``sets`` has the thresholds by the fold held out; -1 holds out none.
    """
    width = len(next(iter(sets.values())))

    def encode(batches):
        bins, labels, folds = {g: [] for g in sets}, [np.empty(0, "int8")], [np.empty(0, "int32")]
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).T
            labels.append(batch.column("y").to_numpy(zero_copy_only=False).astype("int8"))
            folds.append(batch.column("fold").to_numpy(zero_copy_only=False))
            for g, cuts in sets.items():
                bins[g].append(np.stack([np.searchsorted(c, own) for c, own in zip(cuts, x)]).astype("uint8"))
        y, in_fold = np.concatenate(labels), np.concatenate(folds)
        for g, parts in bins.items():
            whole = np.concatenate([*parts, np.empty((width, 0), "uint8")], axis=1)
            told = [v[..., in_fold != g].tobytes() for v in (whole, y)] + [v[..., in_fold == g].tobytes() for v in (whole, y)]
            columns = [pa.array([g], pa.int32()), *[pa.array([v], pa.binary()) for v in told]]
            yield pa.RecordBatch.from_arrays(columns, names=["set", "bins", "y", "held_bins", "held_y"])

    known = F.col(label).cast("double")
    checked = F.when(known.isin(0.0, 1.0), known).otherwise(F.raise_error(F.lit("a label is not 0 or 1")))
    narrow = vectors.select(vector_to_array("features").alias("x"), checked.alias("y"), F.col(fold).alias("fold"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    told = narrow.coalesce(max(cores, -(-rows // _BLOCK_ROWS))).mapInArrow(
        encode, "set int, bins binary, y binary, held_bins binary, held_y binary"
    )

    def block(r):
        parts = [np.frombuffer(v, k) for v, k in zip(r[1:], ("uint8", "int8") * 2)]
        return r[0], parts[0].reshape(width, -1), parts[1], parts[2].reshape(width, -1), parts[3]

    return _alone(told.rdd.map(block)).persist(StorageLevel.MEMORY_AND_DISK)


@contextmanager
def kept_blocks(*args):
    found = blocks(*args)
    try:
        yield found
    finally:
        found.unpersist()


# --- passes over blocks ------------------------------------------------------


class Tree:
    """The nodes of one tree, a child after its parent and right after left."""

    def __init__(self):
        self.feature, self.bin, self.left, self.gain = [-1], [255], [0], [-1.0]
        self.stats, self.impurity, self.level = [None], [0.0], [0]

    def value(self) -> np.ndarray:
        """What each node says."""
        return np.array([total / n for n, total, _ in self.stats])

    def tables(self, cut: int = DEEPEST) -> tuple:
        """(feature, bin, left child) by node; a leaf, or a node on the level ``cut``, leads to itself."""
        feature, own = np.array(self.feature), np.arange(len(self.feature))
        ends = (feature < 0) | (np.array(self.level) >= cut)
        return (
            np.where(ends, 0, feature), np.where(ends, 255, self.bin).astype("uint8"),
            np.where(ends, own, self.left),
        )

    def add(self, feature: int, split: int, gain: float, node: int, children: Sequence[tuple]) -> int:
        """Split a node; ``children`` are (stats, impurity). The number of the left child, the right is the next."""
        self.feature[node], self.bin[node], self.gain[node], self.left[node] = feature, split, gain, len(self.feature)
        for stats, impurity in children:
            self.feature.append(-1)
            self.bin.append(255)
            self.left.append(0)
            self.gain.append(-1.0)
            self.stats.append(stats)
            self.impurity.append(impurity)
            self.level.append(self.level[node] + 1)
        return self.left[node]

    def graft(self, node: int, grown: dict) -> None:
        """Put a tree in the place of a leaf."""
        shift = len(self.feature) - 1
        left = [x + shift if f >= 0 else 0 for f, x in zip(grown["feature"], grown["left"])]
        for name, values in {**grown, "left": left}.items():
            mine = getattr(self, name)
            mine[node] = values[0]
            mine.extend(values[1:])


def step(bins: np.ndarray, node: np.ndarray | None, tables: tuple) -> np.ndarray:
    """The next node of each row; all start at the root."""
    feature, split, left = tables
    if node is None:
        return left[0] + (bins[feature[0]] > split[0])
    found, begins, values = np.empty(bins.shape[1], "int64"), feature * bins.shape[1], bins.reshape(-1)
    for begin in range(0, len(found), _ROWS):
        own = node[begin : begin + _ROWS]
        place = begins.take(own, mode="clip")
        place += np.arange(begin, begin + len(own))
        goes_right = values.take(place, mode="clip") > split.take(own, mode="clip")
        np.add(left.take(own, mode="clip"), goes_right, out=found[begin : begin + _ROWS])
    return found


def walk(bins: np.ndarray, tables: tuple, levels: int) -> np.ndarray:
    """The node of each row after so many steps."""
    found = np.zeros(bins.shape[1], "int64")
    for begin in range(0, len(found) if levels else 0, _ROWS):
        part, node = np.ascontiguousarray(bins[:, begin : begin + _ROWS]), None
        for _ in range(levels):
            node = step(part, node, tables)
        found[begin : begin + _ROWS] = node
    return found


def residuals(y: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What the next tree is to learn: labels -1 and 1 at first, then the loss's negative gradient."""
    sign = y * 2.0 - 1.0
    return sign if margin is None else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


def joined(widths: Sequence[int], most: int) -> list[list[int]]:
    """Features counted together: their bins have at most ``most`` combinations, the widest features first."""
    groups: list[list[int]] = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        room = (own for own in groups if math.prod(widths[i] for i in own) * widths[f] <= most)
        own = next(room, None)
        if own is None:
            groups.append([f])
        else:
            own.append(f)
    return groups


def level_sums(bins: np.ndarray, r: np.ndarray, slot: np.ndarray | None, slots: int, splits: np.ndarray, width: int) -> np.ndarray:
    """Rows, sums and sums of squares of ``r`` by feature, slot and bin.

    Many rows are summed by combinations of several features' bins, and those sums added up. Few are
    summed in the order of the rows, as Spark does, since equal gains are common among few rows.
    """
    widths = [int(n) + 1 for n in splits]
    rows, most = len(r), 1
    if len(r) >= _MANY:  # so many at a time that they stay in the processor's cache, but more than the sums
        rows = max(_MANY, 8 * slots * width)
        most = min(_JOINT, rows // (8 * slots))
    groups = joined(widths, most)
    totals = [np.zeros((3, slots * math.prod(widths[f] for f in group))) for group in groups]
    for begin in range(0, len(r), rows):
        part, own = slice(begin, begin + rows), r[begin : begin + rows]
        weights = (None, own, own * own)
        for group, total in zip(groups, totals):
            cells = total.shape[1] // slots
            code = bins[group[0], part].astype("uint16")
            for f in group[1:]:
                code = code * np.uint16(widths[f]) + bins[f, part]
            cell = code.astype("int64") if slot is None else slot[part] * cells + code
            for sums, weight in zip(total, weights):
                sums += np.bincount(cell, weight, len(sums))
    found = np.zeros((3, len(bins), slots, width))
    for group, total in zip(groups, totals):
        told = total.reshape(3, slots, *[widths[f] for f in group])
        for at, f in enumerate(group):
            others = tuple(a + 2 for a in range(len(group)) if a != at)
            found[:, f, :, : widths[f]] = told.sum(axis=others)
    return found


def _variance(stats: np.ndarray) -> np.ndarray:
    n, total, squares = stats
    return np.divide(squares - np.divide(total * total, n, out=np.zeros_like(n), where=n != 0), n, out=np.zeros_like(n), where=n != 0)


def best_splits(sums: np.ndarray, splits: np.ndarray, impurity: np.ndarray | None) -> tuple:
    """For each slot the first split of greatest gain: (gain, feature, bin, left, right, whole, impurity).

    ``splits`` is the number of candidates by feature. The root's own ``impurity`` follows from its sums.
    """
    upto = np.cumsum(sums, axis=3)
    left = upto[..., :-1]
    right = upto[..., -1:] - left
    slots = sums.shape[2]
    f = int(np.argmax(splits > 0))
    whole = left[:, f, :, 0] + right[:, f, :, 0]
    if impurity is None:
        impurity = _variance(whole)
    rows = left[0] + right[0]
    gain = np.full(left.shape[1:], -np.inf)
    valid = (left[0] > 0) & (right[0] > 0) & (np.arange(left.shape[3]) < splits[:, None, None])
    shares = [np.divide(side[0], rows, out=np.zeros_like(rows), where=rows != 0) for side in (left, right)]
    made = impurity[None, :, None] - shares[0] * _variance(left) - shares[1] * _variance(right)
    gain[valid] = made[valid]
    by_slot = gain.transpose(1, 0, 2).reshape(slots, -1)
    best = by_slot.argmax(axis=1)
    feature, split, at = best // left.shape[3], best % left.shape[3], np.arange(slots)
    return by_slot[at, best], feature, split, left[:, feature, at, split], right[:, feature, at, split], whole, impurity


# --- growing -----------------------------------------------------------------


def _split(tree: Tree, own: Sequence[int], sums: np.ndarray, splits: np.ndarray, depth: int) -> list[int]:
    """Split the nodes whose ``sums`` are given, all of one level; the children that may be split in turn."""
    level, open_next = tree.level[own[0]], []
    for k in range(0, len(own), _CHUNK):
        part = own[k : k + _CHUNK]
        impurity = np.array([tree.impurity[i] for i in part]) if level else None
        open_next += _take(tree, part, best_splits(sums[:, :, k : k + _CHUNK], splits, impurity), depth)
    return open_next


def _take(tree: Tree, own: Sequence[int], found: tuple, depth: int) -> list[int]:
    """Give the nodes the splits found for them; the children that may be split in turn."""
    gain, feature, split, left, right, whole, impurity = found
    if tree.stats[own[0]] is None:
        tree.stats[0], tree.impurity[0] = tuple(whole[:, 0].tolist()), float(impurity[0])
    below = [(v.T.tolist(), _variance(v).tolist()) for v in (left, right)]
    open_next = []
    for i, node in enumerate(own):
        if gain[i] > 0:
            children = [(tuple(stats[i]), variance[i]) for stats, variance in below]
            at = tree.add(int(feature[i]), int(split[i]), float(gain[i]), node, children)
            if tree.level[at] < depth:
                open_next += [at + c for c in (0, 1) if abs(children[c][1]) >= _EPSILON]
    return open_next


def _slot_of(tree: Tree, own: Sequence[int]) -> np.ndarray:
    found = np.full(len(tree.feature), -1)
    found[own] = np.arange(len(own))
    return found


def grow_below(tree: Tree, bins: np.ndarray, r: np.ndarray, splits: np.ndarray, width: int, depth: int) -> None:
    """Grow a tree of one node, which may stand on any level, to the level ``depth`` from the rows in it."""
    own, node = [0], None
    while own:
        slot = None
        if node is not None:
            slot = _slot_of(tree, own)[node]
            if slot.min(initial=0) < 0:
                inside = np.flatnonzero(slot >= 0)
                bins, r, node, slot = bins[:, inside], r[inside], node[inside], slot[inside]
        own = _split(tree, own, level_sums(bins, r, slot, len(own), splits, width), splits, depth)
        if own:
            node = step(bins, node, tree.tables())


def _pass_over_large(paired: RDD, trees: dict, large: dict, level: int, splits: dict, width: int) -> dict:
    """What ``best_splits`` finds for the large nodes of a level, by set."""
    told = {g: (trees[g].tables(), _slot_of(trees[g], own), len(own)) for g, own in large.items()}
    impurities = {g: np.array([trees[g].impurity[i] for i in own]) if level else None for g, own in large.items()}
    order = sorted(large)

    def add_up(part, elements):
        for (g, bins, y, *_), margin in elements:
            if g in told:
                tables, slot_of, slots = told[g]
                r, slot = residuals(y, margin), None
                if level:
                    slot = slot_of[walk(bins, tables, level)]
                    if slot.min(initial=0) < 0:
                        inside = np.flatnonzero(slot >= 0)
                        bins, r, slot = bins[:, inside], r[inside], slot[inside]
                yield order.index(g), (part, level_sums(bins, r, slot, slots, splits[g], width))

    def decide(elements):
        held: dict[int, list] = {}
        for key, sums in elements:
            held.setdefault(order[key], []).append(sums)
        for g, sums in held.items():
            total = None
            for _, s in sorted(sums, key=lambda x: x[0]):  # in one order, whichever comes first
                total = s if total is None else np.add(total, s, out=total)
            yield g, best_splits(total, splits[g], impurities[g])

    return dict(paired.mapPartitionsWithIndex(add_up).partitionBy(len(order), lambda k: k).mapPartitions(decide).collect())


def _deal(small: dict[tuple, int], cores: int) -> tuple[dict[tuple, int], int]:
    """The task of each small node, with about as many rows as the others, and how many tasks there are."""
    tasks = min(len(small), max(cores, -(-sum(small.values()) // _BLOCK_ROWS)))
    load, task_of = [0] * tasks, {}
    for at, n in sorted(small.items(), key=lambda x: (-x[1], x[0])):
        task_of[at] = load.index(min(load))
        load[task_of[at]] += n
    return task_of, tasks


def _grow_small(paired: RDD, trees: dict, small: dict, level: int, splits: dict, width: int, depth: int) -> None:
    """Bring the rows of each small node together and grow what is below it."""
    task_of, tasks = _deal(small, paired.context.defaultParallelism)
    nodes = {g: [i for h, i in small if h == g] for g in {g for g, _ in small}}
    told = {g: (trees[g].tables(), _slot_of(trees[g], own)) for g, own in nodes.items()}
    start = {(g, i): (trees[g].stats[i], trees[g].impurity[i], trees[g].level[i]) for g, i in small}

    def send(part, elements):
        for (g, bins, y, *_), margin in elements:
            if g in told:
                r = residuals(y, margin)
                if not level:
                    yield task_of[g, 0], (g, 0, part, bins, r)
                    continue
                slot = told[g][1][walk(bins, told[g][0], level)]
                order = np.argsort(slot.astype("int16"), kind="stable")
                ends = np.searchsorted(slot[order], np.arange(len(nodes[g]) + 1))
                for i, a, b in zip(nodes[g], ends, ends[1:]):
                    yield task_of[g, i], (g, i, part, bins[:, order[a:b]], r[order[a:b]])

    def grow_each(elements):
        held: dict[tuple, list] = {}
        for _, (g, i, part, bins, r) in elements:
            held.setdefault((g, i), []).append((part, bins, r))
        for g, i in sorted(held):
            parts = sorted(held.pop((g, i)), key=lambda x: x[0])
            tree = Tree()
            tree.stats[0], tree.impurity[0], tree.level[0] = start[g, i]
            grow_below(tree, np.concatenate([x[1] for x in parts], axis=1), np.concatenate([x[2] for x in parts]), splits[g], width, depth)
            yield g, i, vars(tree)

    dealt = paired.mapPartitionsWithIndex(send).partitionBy(tasks, lambda k: k)
    for g, i, grown in sorted(dealt.mapPartitions(grow_each).collect(), key=lambda x: x[:2]):
        trees[g].graft(i, grown)


def grow(rows: RDD, margins: RDD | None, sets: dict, sizes: dict, depth: int) -> dict[int, Tree]:
    """One tree for each set, whose rows to train on are told by ``sizes``."""
    splits = {g: np.array([len(c) for c in cuts]) for g, cuts in sets.items()}
    width = max(1, *(len(c) for cuts in sets.values() for c in cuts)) + 1
    trees = {g: Tree() for g in sets}
    paired = rows.map(lambda block: (block, None)) if margins is None else rows.zip(margins)
    large = {g: [0] for g in sets if sizes[g] > SMALL}
    small = {(g, 0): n for g, n in sizes.items() if n <= SMALL}
    level = 0
    while large:
        found = _pass_over_large(paired, trees, large, level, splits, width)
        after = {g: _take(trees[g], large[g], told, depth) for g, told in found.items()}
        rows_in = {(g, i): int(trees[g].stats[i][0]) for g, own in after.items() for i in own}
        small |= {at: n for at, n in rows_in.items() if n <= SMALL}
        large = {g: left for g, own in after.items() if (left := [i for i in own if rows_in[g, i] > SMALL])}
        level += 1
    if small:
        _grow_small(paired, trees, small, level, splits, width, depth)
    return trees


def boost(
    spark: SparkSession, rows: RDD, sets: dict, sizes: dict, depth: int, first: dict[int, Tree],
    *, iterations: int, step_size: float, interval: int,
) -> dict[int, list]:
    """By set the trees of depth ``depth`` as (tree, weight), ``first`` being the first, cut off there.

    The margins of the rows are kept from tree to tree; every ``interval`` trees they are written to the
    shared folder instead of recomputable from the first tree on.
    """
    found = {g: [(first[g], 1.0)] for g in sets}
    told = {g: (t.tables(depth), t.value()) for g, t in first.items()}
    margins = _alone(rows.map(lambda b: told[b[0]][1][walk(b[1], told[b[0]][0], depth)]))
    before, written = None, []
    for i in range(1, iterations):
        margins.persist(StorageLevel.MEMORY_AND_DISK)
        trees = grow(rows, margins, sets, sizes, depth)
        if before is not None:
            before.unpersist()
        for g, tree in trees.items():
            found[g].append((tree, step_size))
        before, margins = margins, _next_margins(rows, margins, trees, depth, step_size)
        if interval > 0 and i % interval == 0:
            margins.checkpoint()
            written.append(margins)
    if before is not None:
        before.unpersist()
    for rdd in written:
        if rdd.getCheckpointFile():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile())
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return found


def _next_margins(rows: RDD, margins: RDD, trees: dict, depth: int, step_size: float) -> RDD:
    told = {g: (t.tables(), t.value()) for g, t in trees.items()}

    def add(x):
        (g, bins, *_), margin = x
        return margin + told[g][1][walk(bins, told[g][0], depth)] * step_size

    return _alone(rows.zip(margins).map(add))


def held_out_counts(rows: RDD, boosted: dict[int, list], depth: int) -> list[tuple]:
    """(set, label, prediction, n) of the rows held out."""
    told = {g: [(t.tables(depth), t.value(), w) for t, w in trees] for g, trees in boosted.items()}

    def count(block):
        g, _, _, bins, y = block
        margin = np.zeros(len(y))
        for tables, value, weight in told[g]:
            margin += value[walk(bins, tables, depth)] * weight
        return g, np.bincount(y.astype("int64") * 2 + (margin > 0.0), minlength=4)

    cells: dict[int, np.ndarray] = {}
    for g, counts in rows.map(count).collect():
        cells[g] = cells.get(g, 0) + counts
    return [(g, float(c // 2), float(c % 2), int(n)) for g, counts in sorted(cells.items()) for c, n in enumerate(counts) if n]


# --- the model ---------------------------------------------------------------


def _node_rows(tree: Tree, cuts: list[np.ndarray], depth: int) -> list[tuple]:
    """The nodes as Spark writes them, in preorder; leaves that say the same are merged into their parent."""
    value = tree.value()

    def leaf(i: int) -> bool:
        return tree.feature[i] < 0 or tree.level[i] >= depth

    ends: dict[int, float] = {}
    for i in reversed(range(len(value))):
        if leaf(i):
            ends[i] = value[i]
        elif tree.left[i] in ends and tree.left[i] + 1 in ends and ends[tree.left[i]] == ends[tree.left[i] + 1]:
            ends[i] = ends[tree.left[i]]
    rows: list = []

    def place(i: int) -> int:
        at = len(rows)
        stats = [float(x) for x in tree.stats[i]]
        if i in ends:
            rows.append((at, float(ends[i]), tree.impurity[i], stats, int(stats[0]), -1.0, -1, -1, (-1, [], -1)))
            return at
        rows.append(None)
        children = place(tree.left[i]), place(tree.left[i] + 1)
        split = (tree.feature[i], [float(cuts[tree.feature[i]][tree.bin[i]])], -1)
        rows[at] = (at, float(value[i]), tree.impurity[i], stats, int(stats[0]), tree.gain[i], *children, split)
        return at

    place(0)
    return rows


_NODES = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,"
    "gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)


def as_model(spark: SparkSession, estimator: GBTClassifier, boosted: list, cuts: list[np.ndarray], depth: int) -> GBTClassificationModel:
    """Spark's model of these trees, by way of the files that Spark keeps models in."""

    def told(kind: str, uid: str, names=None, **more) -> str:
        maps = [{p.name: v for p, v in m.items() if names is None or p.name in names} for m in (estimator._paramMap, estimator._defaultParamMap)]
        return json.dumps({
            "class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
            "uid": uid, "paramMap": maps[0], "defaultParamMap": maps[1], **more,
        })

    of_tree = {
        "cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
        "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed", "impurity",
    }
    path = fresh_path(spark, "model")
    whole = told("classification.GBTClassificationModel", estimator.uid, numFeatures=len(cuts), numTrees=len(boosted))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    single = [(i, told("regression.DecisionTreeRegressionModel", f"dtr_{estimator.uid[-12:]}_{i}", of_tree), w) for i, (_, w) in enumerate(boosted)]
    spark.createDataFrame(single, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [(i, row) for i, (tree, _) in enumerate(boosted) for row in _node_rows(tree, cuts, depth)]
    spark.createDataFrame(nodes, _NODES).coalesce(1).write.parquet(f"{path}/data")
    model = GBTClassificationModel.load(path)
    remove(spark, path)
    return model


def has_nominal(vectors: DataFrame) -> bool:
    attributes = vectors.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    return bool(attributes.get("nominal") or attributes.get("binary"))
