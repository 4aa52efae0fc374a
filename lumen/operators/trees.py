"""Fitted tree ensembles as flat arrays, and Shapley attributions of their outputs.

A leaf's share of an attribution depends on the path to it only: with the
features of the path, z the share of training rows that each one's splits let
through and o whether the row passes them, it is v (o_j - z_j) times the
integral over t from 0 to 1 of the product over the other features of
z_i (1 - t) + o_i t. That product is a polynomial of the path's length, which
Gauss-Legendre points integrate exactly; so a batch of rows is a few array
operations a leaf, and coalitions are never enumerated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.persist import new_folder

#: Rows taken through an ensemble at a time.
ROWS = 4096


@dataclass
class Tree:
    """Nodes in arrays; node 0 is the root. A row goes left if its value is at most the threshold, or among the categories; a missing value goes where `missing_left` says, and right without it."""

    feature: np.ndarray  # -1 at leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # of each node
    cover: np.ndarray  # training rows
    weight: float = 1.0
    output: int = 0
    categories: dict[int, list[float]] = field(default_factory=dict)
    missing_left: np.ndarray | None = None

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        if node in self.categories:
            return np.isin(x, self.categories[node])
        left = x <= self.threshold[node]
        return left | np.isnan(x) if self.missing_left is not None and self.missing_left[node] else left

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0 or not len(rows):
                at[rows] = node
                continue
            left = self.goes_left(node, x[rows, self.feature[node]])
            todo += [(int(self.left[node]), rows[left]), (int(self.right[node]), rows[~left])]
        return at

    def paths(self) -> list[tuple[int, dict[int, list[tuple[int, bool]]], dict[int, float]]]:
        """leaf, splits by feature as (node, goes left), and the share of rows that each feature's splits let through."""
        out, todo = [], [(0, {}, {})]
        while todo:
            node, splits, share = todo.pop()
            f = int(self.feature[node])
            if f < 0:
                out.append((node, splits, share))
                continue
            for child, way in ((int(self.left[node]), True), (int(self.right[node]), False)):
                part = float(self.cover[child]) / float(self.cover[node]) if self.cover[node] else 0.0
                todo.append((child, splits | {f: [*splits.get(f, []), (node, way)]}, share | {f: share.get(f, 1.0) * part}))
        return out

    def state(self) -> dict:
        return {"feature": self.feature.tolist(), "threshold": self.threshold.tolist(), "left": self.left.tolist(), "right": self.right.tolist(), "value": self.value.tolist(), "cover": self.cover.tolist(), "weight": self.weight, "output": self.output, "missing_left": None if self.missing_left is None else self.missing_left.tolist()}

    @classmethod
    def of(cls, s: dict) -> Tree:
        return cls(np.array(s["feature"], np.int64), np.array(s["threshold"], float), np.array(s["left"], np.int64), np.array(s["right"], np.int64), np.array(s["value"], float), np.array(s["cover"], float), s["weight"], s["output"], {}, None if s["missing_left"] is None else np.array(s["missing_left"], bool))


def shapley(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Attribution of the tree's output to each feature, a row a row of x; features that no row of training let through to a leaf count by the other way."""
    out = np.zeros(x.shape)
    for leaf, splits, share in tree.paths():
        v, d = float(tree.value[leaf]) * tree.weight, len(splits)
        if not d or not v:
            continue
        names = list(splits)
        passed = np.stack([np.logical_and.reduce([tree.goes_left(n, x[:, f]) == way for n, way in splits[f]]) for f in names], axis=1)
        t, w = np.polynomial.legendre.leggauss(d // 2 + 1)
        t, w = (t + 1) / 2, w / 2
        z = np.array([share[f] for f in names])
        low = z[:, None] * (1 - t)
        for code in np.unique(pack := passed @ (1 << np.arange(d)) if d < 62 else np.arange(len(x))):
            o = passed[np.argmax(pack == code)].astype(float)
            each = low + o[:, None] * t
            rows = pack == code
            for j, f in enumerate(names):
                others = np.prod(np.delete(each, j, axis=0), axis=0)
                out[rows, f] += v * (o[j] - z[j]) * float(w @ others)
    return out


@dataclass
class Ensemble:
    """Trees whose weighted values add up, from `start`, to each output."""

    trees: list[Tree]
    start: list[float]

    def outputs(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.start, float), (len(x), 1))
        for t in self.trees:
            out[:, t.output] += t.weight * t.value[t.leaf_of(x)]
        return out

    def expected(self, output: int = 0) -> float:
        """The mean output over the training rows."""
        total = self.start[output]
        for t in self.trees:
            if t.output == output:
                leaves = t.feature < 0
                total += t.weight * float(t.value[leaves] @ t.cover[leaves]) / float(t.cover[0])
        return total

    def shapley(self, x: np.ndarray, output: int = 0) -> np.ndarray:
        out = np.zeros(x.shape)
        for t in self.trees:
            if t.output == output:
                out += shapley(t, x)
        return out


def _depth_first(rows: list, value) -> Tree:
    rows = sorted(rows, key=lambda r: r["id"])
    split = [r["split"] for r in rows]
    plain = [s["leftCategoriesOrThreshold"][0] if s["featureIndex"] >= 0 and s["numCategories"] == -1 else np.nan for s in split]
    categories = {i: list(s["leftCategoriesOrThreshold"]) for i, s in enumerate(split) if s["featureIndex"] >= 0 and s["numCategories"] != -1}
    leaf = np.array([r["leftChild"] < 0 for r in rows])
    return Tree(np.where(leaf, -1, [s["featureIndex"] for s in split]), np.array(plain, float), np.array([r["leftChild"] for r in rows]), np.array([r["rightChild"] for r in rows]), np.array([value(r) for r in rows], float), np.array([r["rawCount"] for r in rows], float), categories=categories)


def ensemble(spark, model: Model, output: int = 1) -> Ensemble:
    """The trees of a fitted model of Spark's, read from what it saves; the output is the prediction, the margin of a boosted classifier, or else the probability of class `output`.

    A model of ours that has trees gives its own.
    """
    if hasattr(model, "ensemble"):
        return model.ensemble()
    path = new_folder(spark, "trees")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    nodes = data.select("treeID", "nodeData.*") if "treeID" in data.columns else data.select(F.lit(0).alias("treeID"), "*")
    by: dict[int, list] = {}
    for r in nodes.collect():  # a model's nodes: bounded by its depth and number of trees
        by.setdefault(r["treeID"], []).append(r)
    kind = type(model).__name__
    classes = "Classif" in kind and "GBT" not in kind
    value = (lambda r: r["impurityStats"][output] / max(sum(r["impurityStats"]), 1e-300)) if classes else (lambda r: r["prediction"])
    weights = list(model.treeWeights) if "GBT" in kind else [1 / len(by)] * len(by)
    trees = []
    for i in sorted(by):
        t = _depth_first(by[i], value)
        t.weight = float(weights[i])
        trees.append(t)
    return Ensemble(trees, [0.0])


def attributions(df: DataFrame, model: Model | Ensemble, output: int = 1, features: str = "features") -> DataFrame:
    """`df` with `attribution`, an array with a number a feature, and `expected`: they add up to the model's output on every row.

    The ensemble travels with the tasks; its size is that of the model. Rows stay where they are.
    """
    made = model if isinstance(model, Ensemble) else ensemble(df.sparkSession, model, output)
    k = output if len(made.start) > 1 else 0

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, 1))
            yield pd.Series([row for lo in range(0, len(x), ROWS) for row in made.shapley(x[lo : lo + ROWS], k)])

    x = F.col(features) if df.schema[features].dataType.typeName() == "array" else vector_to_array(features)
    return df.withColumns({"attribution": explain(x), "expected": F.lit(made.expected(k))})


def importance(df: DataFrame, model: Model | Ensemble, columns: list[str], output: int = 1) -> DataFrame:
    """feature, importance: the mean absolute attribution over the rows of `df` (with `features`)."""
    rows = attributions(df, model, output)
    mean = rows.agg(F.array(*[F.avg(F.abs(F.col("attribution")[i])) for i in range(len(columns))]).alias("m"))
    return mean.select(F.inline(F.arrays_zip(F.array(*[F.lit(c) for c in columns]).alias("feature"), F.col("m").alias("importance"))))


def select_by_attribution(df: DataFrame, model: Model | Ensemble, columns: list[str], share: float = 0.01, output: int = 1) -> list[str]:
    """The columns whose mean absolute attribution is at least a share of the greatest."""
    scores = {r["feature"]: r["importance"] or 0.0 for r in importance(df, model, columns, output).collect()}
    most = max(scores.values(), default=0.0)
    return [c for c in columns if scores[c] >= share * most]
