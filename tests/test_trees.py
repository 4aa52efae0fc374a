"""Attributions of tree ensembles: against enumeration of coalitions, and by their sum."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from lumen.operators import training as T
from lumen.operators import trees as X

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)).round(2)
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    df = spark.createDataFrame([(*map(float, r), float(min(v, 2)), float(r[0] * 2 + (r[1] > 0) * r[2])) for r, v in zip(x, y, strict=True)], [*COLUMNS, "y", "z"])
    return df.cache()


def known(tree: X.Tree, x: np.ndarray, on: set, node: int = 0) -> float:
    """The tree's output where only the features in `on` are known: other splits go both ways by cover."""
    f = tree.feature[node]
    if f < 0:
        return tree.weight * tree.value[node]
    a, b = int(tree.left[node]), int(tree.right[node])
    if f in on:
        return known(tree, x, on, a if tree.goes_left(node, x[f : f + 1])[0] else b)
    return sum(known(tree, x, on, c) * tree.cover[c] for c in (a, b)) / tree.cover[node]


def enumerated(made: X.Ensemble, x: np.ndarray, output: int) -> list[float]:
    n, out = len(x), []
    value = lambda on: sum(known(t, x, on) for t in made.trees if t.output == output)
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        out.append(sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (value({*s, j}) - value(set(s))) for k in range(n) for s in combinations(rest, k)))
    return out


@pytest.mark.parametrize("make, label, out", [
    (lambda: C.DecisionTreeClassifier(maxDepth=5), "binary", lambda: F.col("probability")[1]),
    (lambda: C.RandomForestClassifier(numTrees=5, maxDepth=4, seed=1), "y", lambda: F.col("probability")[1]),
    (lambda: R.DecisionTreeRegressor(maxDepth=6), "z", lambda: F.col("prediction")),
    (lambda: R.RandomForestRegressor(numTrees=4, maxDepth=3, seed=1), "z", lambda: F.col("prediction")),
    (lambda: R.GBTRegressor(maxIter=5, maxDepth=3), "z", lambda: F.col("prediction")),
    (lambda: C.GBTClassifier(maxIter=4, maxDepth=3), "binary", lambda: F.col("margin")),
])
def test_attributions(spark, rows, make, label, out):
    from pyspark.ml.functions import vector_to_array

    df = T.assemble(rows.withColumn("binary", (F.col("y") > 0).cast("double")), COLUMNS, label)
    model = make().fit(df)
    scored = X.attributions(model.transform(df), model)
    if "probability" in scored.columns:
        scored = scored.withColumns({"probability": vector_to_array("probability"), "margin": vector_to_array("rawPrediction")[1]})
    got = scored.select(*COLUMNS, "attribution", "expected", out().alias("out")).collect()
    made = X.ensemble(spark, model)
    for r in got:
        assert sum(r["attribution"]) + r["expected"] == pytest.approx(r["out"], abs=1e-9)
    for r in got[:25]:
        assert r["attribution"] == pytest.approx(enumerated(made, np.array([r[c] for c in COLUMNS]), 0), abs=1e-9)


def test_categories_and_missing_values(spark):
    from pyspark.ml.feature import VectorIndexer

    df = spark.createDataFrame([(float(i % 5), float(i % 3), float(i % 5 in (1, 4)) + (i % 3)) for i in range(200)], "a double, b double, z double")
    made = T.assemble(df, ["a", "b"], "z").drop("z")
    made = VectorIndexer(inputCol="features", outputCol="f2", maxCategories=5, handleInvalid="keep").fit(made).transform(made).drop("features").withColumnRenamed("f2", "features")
    model = R.DecisionTreeRegressor(maxDepth=4).fit(made)
    flat = X.ensemble(spark, model)
    assert any(t.categories for t in flat.trees)
    for r in X.attributions(model.transform(made), flat).collect():
        assert sum(r["attribution"]) + r["expected"] == pytest.approx(r["prediction"], abs=1e-9)
    half = {"feature": [0, -1, 1, -1, -1], "threshold": [1.0, 0, 2.0, 0, 0], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "value": [0, 5.0, 0, -1.0, 2.0], "cover": [10, 4, 6, 1, 5], "weight": 0.5, "output": 0}
    x = np.array([[np.nan, np.nan], [0.0, 9.0], [3.0, np.nan], [3.0, 1.0]])
    for missing, leaves in ((None, [4, 1, 4, 3]), ([True, False, True, False, False], [1, 1, 3, 3])):
        tree = X.Tree.of(half | {"missing_left": missing})
        assert tree.leaf_of(x).tolist() == leaves
        made = X.Ensemble([tree], [1.0])
        assert made.shapley(x).sum(axis=1) + made.expected() == pytest.approx(made.outputs(x)[:, 0])
        assert all(made.shapley(x)[i] == pytest.approx(enumerated(made, x[i], 0)) for i in range(len(x)))


def test_selection_drops_what_says_nothing(spark, rows):
    df = T.assemble(rows, COLUMNS, "z")
    model = R.DecisionTreeRegressor(maxDepth=3).fit(df)
    scores = {r["feature"]: r["importance"] for r in X.importance(df, model, COLUMNS).collect()}
    kept = X.select_by_attribution(df, model, COLUMNS)
    assert "a" in kept and kept == [c for c in COLUMNS if scores[c] >= 0.01 * max(scores.values())]
    assert X.select_by_attribution(df, model, COLUMNS, share=0.99) == ["a"]
