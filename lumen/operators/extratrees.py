"""Extremely randomised trees: a split's threshold is drawn within the range of its node.

A node tries a few features, in an order that follows from the seed, the tree
and the node's place alone; each is cut at a share of the range its values have
in that node, drawn likewise, and the best of these cuts is taken. So nothing is
sorted or binned, and a level is one aggregation: every partition adds up the
labels on both sides of each cut and, as the features that the two children will
try are already known, the ranges of those features on each side. A node whose
drawn features are all constant takes the first of the others that is not, which
costs such nodes a second look. Rows never move; what moves is a row a node that
is open, and nodes are taken in groups of bounded size.

Missing values go right. Every tree sees all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.persist import Saved, frozen
from .trees import Ensemble, Tree

#: Numbers that a task holds for the nodes of one aggregation (8 bytes each).
CELLS = 1 << 22


@dataclass(frozen=True)
class Forest:
    """How trees are grown; `tried` features a node: sqrt, log2 or a share of them."""

    trees: int = 50
    depth: int = 12
    least_split: int = 2
    least_leaf: int = 1
    tried: str | float = "sqrt"
    seed: int = 42

    def features(self, width: int) -> int:
        asked = {"sqrt": math.sqrt(width), "log2": math.log2(width)}[self.tried] if isinstance(self.tried, str) else self.tried * width
        return min(width, max(1, int(asked)))


def drawn(seed: int, tree: int, place: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a node tries the features, and where in its range each feature (by its number) is cut; the root's place is 1, the children of p are at 2p and 2p + 1."""
    rng = np.random.default_rng([seed, tree, place])
    return rng.permutation(width), rng.random(width)


def cut(lo: float, hi: float, share: float) -> float:
    """A threshold with values on both sides."""
    t = lo + share * (hi - lo)
    return t if lo <= t < hi else lo


def impurity(sums: np.ndarray, classes: bool) -> np.ndarray:
    """Rows times Gini impurity of class counts, or the squared deviations of (n, sum, sum of squares)."""
    if classes:
        n = sums.sum(axis=-1)
        return n - (sums**2).sum(axis=-1) / np.maximum(n, 1)
    return np.maximum(sums[..., 2] - sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1), 0.0)


def rows_of(sums: np.ndarray, classes: bool) -> np.ndarray:
    return sums.sum(axis=-1) if classes else sums[..., 0]


def best(sums: np.ndarray, classes: bool, least: int) -> np.ndarray:
    """The cut of greatest gain of each node, the first of equal ones, or -1; `sums` is by node, cut, side and number."""
    whole = sums.sum(axis=2)
    gain = impurity(whole, classes) - impurity(sums, classes).sum(axis=2)
    gain = np.round(gain / np.maximum(impurity(whole, classes), 1e-300), 12)
    gain[(rows_of(sums, classes) < least).any(axis=2)] = -1.0
    pick = gain.argmax(axis=1)
    return np.where(gain[np.arange(len(pick)), pick] >= 0, pick, -1)


@dataclass
class Growing:
    """A tree while it grows."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)

    def add(self, place: int, sums: np.ndarray) -> int:
        self.feature.append(-1), self.threshold.append(np.nan), self.left.append(-1), self.right.append(-1), self.place.append(place), self.sums.append(sums)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right)


@dataclass
class Open:
    """A node with the cuts it tries and the features that its children will."""

    tree: int
    node: int
    feature: list[int]
    threshold: list[float]
    children: tuple[np.ndarray, np.ndarray]


def leaf_of(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The leaf of each row of x, all rows a level at a time."""
    feature, threshold, left, right = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows := rows[feature[at[rows]] >= 0]):
        n = at[rows]
        at[rows] = np.where(x[rows, feature[n]] <= threshold[n], left[n], right[n])
    return at


def _widest(lo: np.ndarray, hi: np.ndarray, cells: np.ndarray, v: np.ndarray) -> None:
    np.minimum.at(lo, cells, np.where(np.isnan(v), np.inf, v))
    np.maximum.at(hi, cells, np.where(np.isnan(v), -np.inf, v))


def _add(sums: np.ndarray, cells: np.ndarray, y: np.ndarray, numbers: int, classes: bool) -> None:
    """Labels into flat `sums`, of which a cell has `numbers`."""
    if classes:
        np.add.at(sums, cells * numbers + y.astype(np.int64), 1.0)
        return
    for i, w in enumerate((np.ones(len(y)), y, y * y)):
        np.add.at(sums, cells * numbers + i, w)


PARTS = "at int, s array<double>, lo array<double>, hi array<double>"


def _emit(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, names: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of `PARTS` (with more columns before them), a thousand at a time."""
    lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.float64()))
    for i in range(0, len(at), 1000):
        j = slice(i, i + 1000)
        more = {k: pa.array(v[j]) for k, v in (names or {}).items()}
        columns = {"at": pa.array(at[j].astype(np.int32)), **more, "s": lists(s[j]), "lo": lists(lo[j]), "hi": lists(hi[j])}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width), b["y"].to_numpy()


def _numbered(forest: dict[int, tuple], nodes: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Of each tree's nodes the place among `nodes`, or -1."""
    number = {t: np.full(len(tree[0]), -1) for t, tree in forest.items()}
    for i, (t, node) in enumerate(nodes):
        number[t][node] = i
    return number


def _ranges(forest: dict[int, tuple], nodes: list[tuple[int, int]], width: int, numbers: int, classes: bool, center: float) -> Callable:
    """Labels and the range of every feature of the nodes, of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbered(forest, nodes)
        s, lo, hi = np.zeros(len(nodes) * numbers), np.full(len(nodes) * width, np.inf), np.full(len(nodes) * width, -np.inf)
        for x, y in _batches(batches, width):
            for t, tree in forest.items():
                at = number[t][leaf_of(tree, x)]
                rows = np.flatnonzero(at >= 0)
                _add(s, at[rows], y[rows] - center, numbers, classes)
                for f in range(width):
                    _widest(lo, hi, at[rows] * width + f, x[rows, f])
        yield from _emit(s.reshape(-1, numbers), lo.reshape(-1, width), hi.reshape(-1, width), np.arange(len(nodes)))

    return run


def _sides(forest: dict[int, tuple], group: list[Open], k: int, width: int, numbers: int, classes: bool, center: float) -> Callable:
    """Labels on both sides of each cut, and there the ranges of the features that the child will try, of a partition."""
    feature, threshold = np.array([o.feature for o in group]), np.array([o.threshold for o in group])
    child = np.array([o.children for o in group])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cells = _numbered(forest, [(o.tree, o.node) for o in group]), len(group) * k * 2
        s, lo, hi = np.zeros(cells * numbers), np.full(cells * k, np.inf), np.full(cells * k, -np.inf)
        seen = np.zeros(len(group), bool)
        for x, y in _batches(batches, width):
            for t, tree in forest.items():
                at = number[t][leaf_of(tree, x)]
                rows = np.flatnonzero(at >= 0)
                at = at[rows]
                seen[at] = True
                for c in range(k):
                    side = np.where(x[rows, feature[at, c]] <= threshold[at, c], 0, 1)
                    cell = (at * k + c) * 2 + side
                    _add(s, cell, y[rows] - center, numbers, classes)
                    for j in range(k):
                        _widest(lo, hi, cell * k + j, x[rows, child[at, side, j]])
        at = np.flatnonzero(seen)
        yield from _emit(s.reshape(len(group), -1)[at], lo.reshape(len(group), -1)[at], hi.reshape(len(group), -1)[at], at)

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """The partitions' parts of each node put together: at, sums, least and greatest."""
    number: dict[int, int] = {}
    kept: list[list[np.ndarray]] = []
    for b in batches:
        parts = [b[c].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("s", "lo", "hi")] if b.num_rows else []
        for r, a in enumerate(b["at"].to_pylist()):
            if a not in number:
                number[a] = len(kept)
                kept.append([p[r].copy() for p in parts])
                continue
            mine = kept[number[a]]
            mine[0] += parts[0][r]
            np.minimum(mine[1], parts[1][r], out=mine[1])
            np.maximum(mine[2], parts[2][r], out=mine[2])
    return (np.array(list(number)), *(np.array([m[i] for m in kept]) for i in range(3)))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, s, lo, hi = _together(batches)
    if len(at):
        yield from _emit(s, lo, hi, at)


def _picked(k: int, numbers: int, classes: bool, least: int) -> Callable:
    """The best cut of each node with the labels and ranges on its sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s, lo, hi = _together(batches)
        if not len(at):
            return
        s, lo, hi = s.reshape(-1, k, 2, numbers), lo.reshape(-1, k, 2 * k), hi.reshape(-1, k, 2 * k)
        pick, n = best(s, classes, least), np.arange(len(at))
        yield from _emit(s[n, pick].reshape(len(at), -1), lo[n, pick], hi[n, pick], at, {"pick": pick.astype(np.int32)})

    return run


class RandomCuts(Estimator):
    """`fit` takes `features` (a vector) and `label` (a number, or 0, 1, ... for classes); rows without a label are left out."""

    def __init__(self, task: str, forest: Forest, classes: int = 2):
        super().__init__()
        self.task, self.forest, self.classes = task, forest, 0 if task == "regression" else classes

    def _fit(self, df: DataFrame) -> RandomCutsModel:
        g, classes, numbers = self.forest, bool(self.classes), self.classes or 3
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).where("y is not null and not isnan(y)")
        first = rows.select(F.size("x")).first()
        width = first[0] if first else 0
        if not width:
            even = np.full((1, numbers), 1 / numbers) if classes else np.zeros((1, 1))
            return RandomCutsModel(self.task, [Growing([-1], [np.nan], [-1], [-1]).arrays()], [even], [np.ones(1)])
        table, k = frozen(rows), g.features(width)
        center = 0.0 if classes else table.agg(F.avg("y")).first()[0]

        def looked(forest: dict[int, tuple], nodes: list[tuple[int, int]]) -> list[Row]:
            parts = table.mapInArrow(_ranges(forest, nodes, width, numbers, classes, center), PARTS)
            return parts.repartition("at").mapInArrow(_whole, PARTS).collect()  # a row a node

        root = looked({0: Growing([-1], [np.nan], [-1], [-1]).arrays()}, [(0, 0)])[0]
        grown = [Growing() for _ in range(g.trees)]
        for tree in grown:
            tree.add(1, np.array(root["s"]))

        def ready(sums: np.ndarray, depth: int) -> bool:
            n = rows_of(sums, classes)
            return depth < g.depth and n >= max(g.least_split, 2 * g.least_leaf) and impurity(sums, classes) > 1e-12 * n

        def opened(t: int, node: int, lo: dict[int, float], hi: dict[int, float], wide: bool) -> Open | None:
            """The node with its cuts, if any of its features (among all, if `wide`) has a range."""
            place = grown[t].place[node]
            order, share = drawn(g.seed, t, place, width)
            tried = [f for f in order[:k] if hi[f] > lo[f]] or [f for f in order if wide and hi[f] > lo[f]][:1]
            if not tried:
                return None
            spare = k - len(tried)  # no row is at or below a missing threshold
            children = tuple(drawn(g.seed, t, c, width)[0][:k] for c in (2 * place, 2 * place + 1))
            return Open(t, node, [*tried, *[0] * spare], [*[cut(lo[f], hi[f], share[f]) for f in tried], *[np.nan] * spare], children)

        lo, hi = dict(enumerate(root["lo"])), dict(enumerate(root["hi"]))
        now = [o for t in range(g.trees) if ready(grown[t].sums[0], 0) and (o := opened(t, 0, lo, hi, True))]
        size, all_size = max(1, CELLS // (k * 2 * (numbers + 2 * k))), max(1, CELLS // (numbers + 2 * width))
        depth = 0
        while now:
            depth, then, narrow = depth + 1, [], []
            for i in range(0, len(now), size):
                group = now[i : i + size]
                forest = {t: grown[t].arrays() for t in sorted({o.tree for o in group})}
                parts = table.mapInArrow(_sides(forest, group, k, width, numbers, classes, center), PARTS).repartition("at")
                schema = PARTS.replace("at int", "at int, pick int")
                for r in sorted(parts.mapInArrow(_picked(k, numbers, classes, g.least_leaf), schema).collect(), key=lambda r: r["at"]):  # a row a node
                    o, pick = group[r["at"]], r["pick"]
                    if pick < 0:
                        continue
                    tree, sums = grown[o.tree], np.array(r["s"]).reshape(2, numbers)
                    tree.feature[o.node], tree.threshold[o.node] = int(o.feature[pick]), float(o.threshold[pick])
                    for side, way in enumerate((tree.left, tree.right)):
                        way[o.node] = child = tree.add(2 * tree.place[o.node] + side, sums[side])
                        if not ready(sums[side], depth):
                            continue
                        ends = [dict(zip(o.children[side].tolist(), r[c][side * k : side * k + k], strict=True)) for c in ("lo", "hi")]
                        made = opened(o.tree, child, *ends, False)
                        then.append(made) if made else narrow.append((o.tree, child))
            for i in range(0, len(narrow), all_size):
                group = narrow[i : i + all_size]
                for r in sorted(looked({t: grown[t].arrays() for t in sorted({t for t, _ in group})}, group), key=lambda r: r["at"]):
                    if made := opened(*group[r["at"]], dict(enumerate(r["lo"])), dict(enumerate(r["hi"])), True):
                        then.append(made)
            now = then
        return RandomCutsModel(self.task, *self._made(grown, center))

    def _made(self, grown: list[Growing], center: float) -> tuple[list[tuple], list[np.ndarray], list[np.ndarray]]:
        sums = [np.array(t.sums) for t in grown]
        if self.classes:
            cover = [s.sum(axis=1) for s in sums]
            values = [s / n[:, None] for s, n in zip(sums, cover, strict=True)]
        else:
            cover = [s[:, 0] for s in sums]
            values = [(center + s[:, 1] / n)[:, None] for s, n in zip(sums, cover, strict=True)]
        return [t.arrays() for t in grown], values, cover


class RandomCutsModel(Saved, Model):
    """prediction, and probability for classes: the mean of the trees' leaves. Of an empty table, 0 and even probabilities."""

    def __init__(self, task: str, forest: list[tuple], values: list[np.ndarray], cover: list[np.ndarray]):
        super().__init__()
        self.task, self.forest, self.values, self.cover = task, forest, values, cover

    def ensemble(self) -> Ensemble:
        """The trees for attributions: one output, of class 1 where there are two; else one a class."""
        which = [1] if self.task == "binary" else list(range(self.values[0].shape[1]))
        made = [Tree(*f, v[:, c], n, 1 / len(self.forest), i) for f, v, n in zip(self.forest, self.values, self.cover, strict=True) for i, c in enumerate(which)]
        return Ensemble(made, [0.0] * len(which))

    def state(self):
        return {"task": self.task, "trees": [[a.tolist() for a in (*f, v, n)] for f, v, n in zip(self.forest, self.values, self.cover, strict=True)]}, {}, []

    @classmethod
    def restore(cls, values, tables, parts):
        trees = [[np.array(a) for a in t] for t in values["trees"]]
        return cls(values["task"], [tuple(t[:4]) for t in trees], [t[4] for t in trees], [t[5] for t in trees])

    def _transform(self, df: DataFrame) -> DataFrame:
        forest, values = self.forest, self.values

        @F.pandas_udf("array<double>")
        def mean(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            x = np.stack(batch.to_numpy()).astype(float)
            return pd.Series(list(sum(v[leaf_of(f, x)] for f, v in zip(forest, values, strict=True)) / len(forest)))

        out = df.withColumn("_m", mean(vector_to_array("features")))
        if self.task == "regression":
            return out.withColumn("prediction", F.col("_m")[0]).drop("_m")
        top = (F.array_position("_m", F.array_max("_m")) - 1).cast("double")
        return out.withColumns({"prediction": top, "probability": array_to_vector("_m")}).drop("_m")
