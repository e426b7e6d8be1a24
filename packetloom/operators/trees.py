"""ML10, ML11: extremely randomised trees and multi-class boosting, grown level by level.

Every level of all trees that grow together is one aggregate over the rows:
tasks route their rows to the open nodes and send sums per split candidate,
which combine before the shuffle; the driver holds the trees, as for any tree
ensemble, and picks the splits. Sums are of whole numbers (weights and slopes
in units of 2^-20), so neither partitioning nor a repeated task changes a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from packetloom.operators.prep import pinned

UNIT = float(1 << 20)
# Sums of one pass over the rows; a wider level takes several passes.
PASS_SUMS = 4_000_000
# Times that a node draws other thresholds when none of its own parts its rows.
TRIES = 4
BINS = 32
# Rows, drawn by a hash, whose quantiles part the bins; all rows count in every sum.
EDGE_ROWS = 20_000
# Rounds of boosting after which the rows' lineage is cut.
CUT_ROUNDS = 10
NODE = "tree int, node int, feature int, threshold double, below int, above int, value array<double>"


@dataclass
class Tree:
    """Nodes as lists: feature -1 is a leaf; rows with value <= threshold go to ``below``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    below: list[int] = field(default_factory=lambda: [0])
    above: list[int] = field(default_factory=lambda: [0])
    value: list[list[float]] = field(default_factory=lambda: [[]])

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.threshold[node] = feature, threshold
        self.below[node], self.above[node] = first, first + 1
        for part, blank in ((self.feature, -1), (self.threshold, 0.0), (self.below, 0), (self.above, 0)):
            part += [blank] * 2
        self.value += [self.value[node], self.value[node]]
        return first, first + 1

    def frozen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Feature, threshold and children (above, below) by node, and the depth; a leaf is its own child."""
        feature = np.array(self.feature)
        leaf, own, depth = feature < 0, np.arange(len(feature)), np.zeros(len(feature), np.int64)
        children = np.stack([np.where(leaf, own, self.above), np.where(leaf, own, self.below)], axis=1)
        level = np.zeros(1, np.int64)
        while len(level := level[~leaf[level]]):
            level, deeper = children[level].ravel(), depth[level[0]] + 1
            depth[level] = deeper
        return np.maximum(feature, 0), np.array(self.threshold), children.ravel(), int(depth.max())


def route(x: np.ndarray, nodes: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Leaf or open node of every row; what is not at or under the threshold, as NaN, goes above."""
    feature, threshold, children, depth = nodes
    at, start, cells = np.zeros(len(x), np.int64), np.arange(len(x)) * x.shape[1], np.ravel(x)
    for _ in range(depth):
        at = children.take(2 * at + (cells.take(start + feature.take(at)) <= threshold.take(at)))
    return at


@dataclass
class TreeModel:
    """Fitted trees; ``margins`` tells whether their values add up to margins (boosting) or are shares to average."""

    classes: int
    trees: list[Tree]
    margins: bool
    losses: list[float] = field(default_factory=list)

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        frozen = [(t.frozen(), np.array([v or [0.0] * self.classes for v in t.value])) for t in self.trees]
        classes, margins = self.classes, self.margins

        def score(x: np.ndarray) -> np.ndarray:
            total = np.zeros((len(x), classes))
            for nodes, values in frozen:
                total += values[route(x, nodes)]
            return softmax(total) if margins else total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)

        return score

    def probabilities(self, df: DataFrame, features: str, out: str) -> DataFrame:
        score, classes = self.scorer(), self.classes

        @F.arrow_udf("array<double>")
        def shares(x: pa.Array) -> pa.Array:
            p = score(_lists(x)) if len(x) else np.zeros((0, classes))
            return pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * classes, p.ravel())

        return df.withColumn(out, shares(vector_to_array(features)))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        rows = [
            (t, n, *cells) for t, tree in enumerate(self.trees)
            for n, cells in enumerate(zip(tree.feature, tree.threshold, tree.below, tree.above, tree.value, strict=True))
        ]
        spark.createDataFrame(rows, NODE).write.parquet(f"{path}/nodes")
        head = [(self.classes, self.margins, [float(x) for x in self.losses])]
        spark.createDataFrame(head, "classes int, margins boolean, losses array<double>").coalesce(1).write.parquet(f"{path}/head")

    @classmethod
    def load(cls, path: str) -> TreeModel:
        spark = SparkSession.active()
        head = spark.read.parquet(f"{path}/head").first()
        trees: dict[int, Tree] = {}
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            tree = trees.setdefault(r.tree, Tree([], [], [], [], []))
            cells = r.feature, r.threshold, r.below, r.above, list(r.value)
            for part, cell in zip((tree.feature, tree.threshold, tree.below, tree.above, tree.value), cells, strict=True):
                part.append(cell)
        return cls(head.classes, [trees[t] for t in sorted(trees)], head.margins, list(head.losses))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """[row, entry] of a list column whose lists are of one length."""
    return _lists(batch.column(name))


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> np.ndarray:
    """Element-wise sum over all batches of what ``add`` puts into an array of ``size`` whole numbers."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                add(batch, total)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["i", "n"])

    out = np.zeros(size, np.int64)
    found = rows.mapInArrow(part, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out[found["i"].to_numpy()] = found["n"].to_numpy()
    return out


def _count(index: np.ndarray, amounts: np.ndarray, total: np.ndarray) -> None:
    # Doubles hold a batch's sums of whole numbers below 2^53 exactly.
    found = np.bincount(index, amounts)
    total[: len(found)] += found.astype(np.int64)


def _rows(df: DataFrame, *more: Column) -> DataFrame:
    units = F.round(F.col("weight") * UNIT).cast("double").alias("w")
    return df.select(vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), units, *more)


@dataclass
class _Open:
    """A node that may split: its place, its box of feature ranges, and how often it has tried."""

    tree: int
    node: int
    low: np.ndarray
    high: np.ndarray
    name: int = 1
    tries: int = 0

    def candidates(self, seed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and random thresholds inside the box, the same for the same seed, tree, place and try."""
        rng = np.random.default_rng([seed, self.tree, self.name & 0xFFFFFFFF, self.name >> 32, self.tries])
        usable = np.flatnonzero(self.high > self.low)
        chosen = rng.permutation(usable)[:k]
        return chosen, self.low[chosen] + rng.random(len(chosen)) * (self.high - self.low)[chosen]


def _impurity(counts: np.ndarray) -> np.ndarray:
    """Gini impurity times weight, over the last axis."""
    n = counts.sum(axis=-1)
    return n - (counts.astype(float) ** 2).sum(axis=-1) / np.maximum(n, 1)


def fit_extra_trees(
    df: DataFrame, classes: int, seed: int = 42, trees: int = 200, depth: int = 20, per_node: int | None = None
) -> TreeModel:
    """ML11: whole rows, random features per node (root of their number), one random threshold each.

    A threshold is drawn inside the box that the node's ancestors leave of the
    training range; a node none of whose draws parts its rows draws again, on
    ranges narrowed to one side of its rows where a draw left the other empty.
    """
    lists = _rows(df)
    wide = len(lists.select("x").first()[0])
    k = per_node or max(1, round(wide**0.5))
    # Vectors are read once; plain columns reach the passes without a step per row.
    rows = lists.select("y", "w", *[F.col("x")[i].alias(f"x{i}") for i in range(wide)]).persist(StorageLevel.DISK_ONLY)
    try:
        return _grown(rows, wide, k, classes, seed, trees, depth)
    finally:
        rows.unpersist()


def _grown(rows: DataFrame, wide: int, k: int, classes: int, seed: int, trees: int, depth: int) -> TreeModel:
    ends = rows.agg(*[f(f"x{i}") for f in (F.min, F.max) for i in range(wide)]).first()
    grown = [Tree() for _ in range(trees)]
    first = np.array(ends[:wide], float), np.array(ends[wide:], float)
    level = [_Open(t, 0, first[0].copy(), first[1].copy()) for t in range(trees)]
    for _ in range(depth + TRIES - 1):
        following: list[_Open] = []
        size = (k + 1) * classes
        room = max(1, PASS_SUMS // size)
        for at in range(0, len(level), room):
            part = level[at : at + room]
            drawn = [o.candidates(seed, k) for o in part]
            sums = _candidate_sums(rows, wide, grown, part, drawn, k, classes).reshape(len(part), k + 1, classes)
            for o, (features, thresholds), found in zip(part, drawn, sums, strict=True):
                following += _grow(grown[o.tree], o, features, thresholds, found, depth)
        level = following
        if not level:
            break
    return TreeModel(classes, grown, False)


def _candidate_sums(
    rows: DataFrame, wide: int, grown: list[Tree], part: list[_Open], drawn: list[tuple], k: int, classes: int
) -> np.ndarray:
    """Weight per open node, candidate (the last one: all rows) and class of the rows at or under the threshold."""
    by_tree: dict[int, list[int]] = {}
    for slot, o in enumerate(part):
        by_tree.setdefault(o.tree, []).append(slot)
    features, thresholds = np.zeros((len(part), k), np.int64), np.full((len(part), k), -np.inf)
    for slot, (f, t) in enumerate(drawn):
        features[slot, : len(f)], thresholds[slot, : len(f)] = f, t
    routes = []
    for tree, slots in by_tree.items():
        slot_of = np.full(len(grown[tree].feature), -1)
        slot_of[[part[s].node for s in slots]] = slots
        routes.append((grown[tree].frozen(), slot_of, min(slots)))

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        x = np.stack([batch.column(f"x{i}").to_numpy() for i in range(wide)], axis=1)
        y, w = batch.column("y").to_numpy().astype(np.int64), batch.column("w").to_numpy()
        for nodes, slot_of, first in routes:
            slot = slot_of[route(x, nodes)]
            here = slot >= 0
            if not here.any():
                continue
            at, s, z, mine = (x, slot, y, w) if here.all() else (x[here], slot[here], y[here], w[here])
            cells, start = np.ravel(at), np.arange(len(at)) * wide
            # Slots of a tree lie together, so sums from its first one on are short.
            cell, own = (s - first) * ((k + 1) * classes) + z, total[first * (k + 1) * classes :]
            _count(cell + k * classes, mine, own)
            for c in range(k):
                low = cells.take(start + features[:, c].take(s)) <= thresholds[:, c].take(s)
                _count(cell + c * classes, mine * low, own)

    return _sums(rows, add, len(part) * (k + 1) * classes)


def _grow(tree: Tree, o: _Open, features: np.ndarray, thresholds: np.ndarray, found: np.ndarray, depth: int) -> list[_Open]:
    """Split the node by its best candidate, or let it draw again, or leave it a leaf; the nodes open next."""
    whole, lower = found[-1], found[:-1][: len(features)]
    weight = whole.sum()
    tree.value[o.node] = (whole / max(weight, 1)).tolist()
    if np.count_nonzero(whole) < 2 or not len(features) or o.name.bit_length() > depth:
        return []
    upper = whole - lower
    gain = _impurity(whole) - _impurity(lower) - _impurity(upper)
    parts = (lower.sum(axis=1) > 0) & (upper.sum(axis=1) > 0)
    if not parts.any():
        o.tries += 1
        empty = lower.sum(axis=1) == 0
        o.low[features[empty]], o.high[features[~empty]] = thresholds[empty], thresholds[~empty]
        return [o] if o.tries < TRIES else []
    best = int(np.argmax(np.where(parts, gain, -np.inf)))
    f, t = int(features[best]), float(thresholds[best])
    nodes = tree.split(o.node, f, t)
    out = []
    for side, (node, counts) in enumerate(zip(nodes, (lower[best], upper[best]), strict=True)):
        tree.value[node] = (counts / counts.sum()).tolist()
        if np.count_nonzero(counts) > 1 and o.name.bit_length() < depth:
            child = _Open(o.tree, node, o.low.copy(), o.high.copy(), 2 * o.name + side)
            (child.low if side else child.high)[f] = t
            out.append(child)
    return out


def fit_boosted(
    df: DataFrame, classes: int, seed: int = 42, rounds: int = 200, depth: int = 8, rate: float = 0.05,
    subsample: float = 0.8, bins: int = BINS, ridge: float = 1.0, least_gain: float = 1e-6, row_key: str = "row_key",
) -> TreeModel:
    """ML10: softmax boosting, one tree per class and round, histograms over bins that all trees share.

    A level of a round is one pass for all classes. Rows carry their margins;
    a round's trees add to them in one more pass, which keeps them on disk, and
    every ``CUT_ROUNDS`` rounds a checkpoint cuts their lineage. ``subsample``
    takes rows by the hash of ``row_key`` and round, where the table has it.
    ``losses`` is the mean log loss of all rows before each round and after the last.
    """
    hashed = F.xxhash64(row_key, F.lit(seed)) if row_key in df.columns else F.lit(0).cast("bigint")
    source = _rows(df, hashed.alias("h"))
    wide = len(source.select("x").first()[0])
    edges = _bin_edges(source, bins)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "x")
            # A bin holds what lies at or under its edge; splits are "bin <= b", that is "value <= edge".
            cells = [np.searchsorted(edges[i], x[:, i], "left") for i in range(wide)]
            column = pa.array(list(np.stack(cells, axis=1)), pa.list_(pa.int32()))
            start = pa.array([[0.0] * classes] * batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([column, *(batch.column(c) for c in "ywh"), start], [*"xywh", "m"])

    kept = "x array<int>, y int, w double, h bigint, m array<double>"
    rows = source.mapInArrow(binned, kept).persist(StorageLevel.DISK_ONLY)
    model = TreeModel(classes, [], True)
    for turn in range(rounds):
        taken = F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(1 << 20)) < int(subsample * (1 << 20))
        if not model.losses:
            model.losses.append(_loss(rows))
        part = rows.filter(taken) if subsample < 1 and row_key in df.columns else rows
        trees = _boost_round(part, classes, wide, edges, depth, ridge, rate, least_gain)
        before, rows = rows, rows.mapInArrow(_adder(trees, classes), kept)
        rows = pinned(rows) if turn % CUT_ROUNDS == CUT_ROUNDS - 1 else rows.persist(StorageLevel.DISK_ONLY)
        model.losses.append(_loss(rows))
        before.unpersist()
        for tree in trees:
            tree.threshold = [float(edges[f][int(t)]) if f >= 0 else 0.0 for f, t in zip(tree.feature, tree.threshold, strict=True)]
        model.trees += trees
    rows.unpersist()
    return model


def _bin_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Per feature at most ``bins`` - 1 quantiles of about ``EDGE_ROWS`` rows, drawn by a hash, so that they follow from the rows alone."""
    share = min(1.0, EDGE_ROWS / max(1, rows.count()))
    drawn = rows.select("x").where(F.pmod(F.xxhash64("x", "h"), F.lit(1 << 20)) < int(share * (1 << 20))).toArrow()
    x = np.sort(drawn["x"].combine_chunks().flatten().to_numpy().reshape(len(drawn), -1), axis=0)
    at = np.arange(1, bins) * len(x) // bins
    return [np.unique(x[at, i]) for i in range(x.shape[1])]


def _loss(rows: DataFrame) -> float:
    top = F.array_max("m")
    norm = F.log(F.aggregate("m", F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top
    return rows.agg((F.sum(F.col("w") * (norm - F.get("m", F.col("y")))) / F.sum("w")).alias("loss")).first()[0]


def _adder(trees: list[Tree], classes: int) -> Callable:
    """Margins plus the trees' values; thresholds are bin numbers here."""
    frozen = [(t.frozen(), np.array([v or [0.0] * classes for v in t.value])) for t in trees]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, margins = _matrix(batch, "x"), _matrix(batch, "m").copy()
            for nodes, values in frozen:
                margins += values[route(x, nodes)]
            column = pa.array(list(margins), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in "xywh"), column], [*"xywh", "m"])

    return add


def _boost_round(
    rows: DataFrame, classes: int, wide: int, edges: list[np.ndarray], depth: int, ridge: float, rate: float, least_gain: float
) -> list[Tree]:
    """One tree per class; thresholds are bin numbers, values stand in the class's place."""
    trees = [Tree() for _ in range(classes)]
    bins = max(len(e) for e in edges) + 1
    level = [(c, 0) for c in range(classes)]
    shrink = rate * (classes - 1) / classes

    def value(c: int, slope: float, curve: float) -> list[float]:
        out = [0.0] * classes
        out[c] = float(-shrink * slope / (curve + ridge))
        return out

    for _ in range(depth):
        room = max(1, PASS_SUMS // (2 * wide * bins))
        following = []
        for at in range(0, len(level), room):
            part = level[at : at + room]
            sums = _slope_sums(rows, trees, part, wide, bins).reshape(len(part), wide, bins, 2) / UNIT
            for (c, node), found in zip(part, sums, strict=True):
                slope, curve = found[0].sum(axis=0)
                trees[c].value[node] = value(c, slope, curve)
                left = np.cumsum(found, axis=1)[:, :-1]
                right = found.sum(axis=1, keepdims=True) - left
                score = lambda s: s[..., 0] ** 2 / (s[..., 1] + ridge)
                gain = score(left) + score(right) - slope**2 / (curve + ridge)
                gain = np.where((left[..., 1] > 0) & (right[..., 1] > 0), gain, -np.inf)
                if not gain.size or gain.max() <= least_gain:
                    continue
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                for child, s in zip(trees[c].split(node, int(f), float(b)), (left[f, b], right[f, b]), strict=True):
                    trees[c].value[child] = value(c, *s)
                    following.append((c, child))
        level = following
        if not level:
            break
    return trees


def _slope_sums(rows: DataFrame, trees: list[Tree], part: list[tuple[int, int]], wide: int, bins: int) -> np.ndarray:
    """Slope and curvature of the log loss per open node, feature and bin; one pass for all classes."""
    routes: dict[int, tuple] = {}
    for slot, (c, node) in enumerate(part):
        if c not in routes:
            routes[c] = trees[c].frozen(), np.full(len(trees[c].feature), -1)
        routes[c][1][node] = slot

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        x, y, w = _matrix(batch, "x"), batch.column("y").to_numpy(), batch.column("w").to_numpy()
        p = softmax(_matrix(batch, "m"))
        for c, (nodes, slot_of) in routes.items():
            slot = slot_of[route(x, nodes)]
            here = np.flatnonzero(slot >= 0)
            if not len(here):
                continue
            mine = p[here, c]
            slopes, curves = np.rint(w[here] * (mine - (y[here] == c))), np.rint(w[here] * mine * (1 - mine))
            for f in range(wide):
                cell = ((slot[here] * wide + f) * bins + x[here, f]) * 2
                _count(cell, slopes, total)
                _count(cell + 1, curves, total)

    return _sums(rows, add, len(part) * wide * bins * 2)
