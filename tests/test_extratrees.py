"""Extremely randomised trees: against a local build from the same draws, and by what must hold of them."""

from __future__ import annotations

import numpy as np
import pytest

from lumen.functions import persist
from lumen.operators import extratrees as E
from lumen.operators import training as T
from lumen.operators import trees as X


def local(x, y, g, tree, classes):
    """One tree, recursively over all rows: (feature, threshold, left, right), or the leaf's value."""
    k, width = g.features(x.shape[1]), x.shape[1]

    def spread(v):
        if not classes:
            return ((v - v.mean()) ** 2).sum() if len(v) else 0.0
        n = np.bincount(v.astype(int), minlength=classes)
        return len(v) - (n**2).sum() / max(1, len(v))

    def grow(rows, place, depth):
        v = y[rows]
        leaf = tuple(np.bincount(v.astype(int), minlength=classes) / len(v)) if classes else v.mean()
        if depth == g.depth or len(rows) < max(g.least_split, 2 * g.least_leaf) or spread(v) <= 1e-9:
            return leaf
        order, share = E.drawn(g.seed, tree, place, width)
        ends = {f: (np.nanmin(x[rows, f]), np.nanmax(x[rows, f])) for f in range(width) if not np.isnan(x[rows, f]).all()}
        moving = [f for f in order if f in ends and ends[f][0] < ends[f][1]]
        found = None
        for f in [f for f in order[:k] if f in moving] or moving[:1]:
            t = ends[f][0] + share[f] * (ends[f][1] - ends[f][0])
            a, b = rows[x[rows, f] <= t], rows[~(x[rows, f] <= t)]
            if min(len(a), len(b)) < g.least_leaf:
                continue
            gain = spread(v) - spread(y[a]) - spread(y[b])
            if found is None or gain > found[0] + 1e-9:
                found = (gain, f, t, a, b)
        if found is None:
            return leaf
        _, f, t, a, b = found
        return (f, t, grow(a, 2 * place, depth + 1), grow(b, 2 * place + 1, depth + 1))

    return grow(np.arange(len(y)), 1, 0)


def follow(node, row):
    while isinstance(node, tuple) and len(node) == 4:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def table(spark, x, y):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} double" for n in names) + ", y double")
    return T.assemble(df.repartition(3), names, "y").cache()


def data(task):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=240), rng.integers(0, 3, 240), np.full(240, 2.0), rng.random(240) ** 3, rng.integers(0, 2, 240)])
    x[rng.random(240) < 0.1, 3] = np.nan
    raw = x[:, 0] * 2 + x[:, 1] * x[:, 4] + np.nan_to_num(x[:, 3], nan=3)
    return x, raw.round(2) if task == "regression" else np.digitize(raw, [1.0, 2.5][: 1 if task == "binary" else 2])


@pytest.mark.parametrize("task, classes, forest", [
    ("regression", 0, E.Forest(trees=3, depth=6, tried=1.0)),
    ("regression", 0, E.Forest(trees=4, depth=5, least_split=20, least_leaf=6)),
    ("binary", 2, E.Forest(trees=2, depth=30, tried=0.2)),
    ("multiclass", 3, E.Forest(trees=4, depth=5, tried="log2", seed=7)),
])
def test_equal_to_a_local_build(spark, monkeypatch, task, classes, forest):
    monkeypatch.setattr(E, "CELLS", 300)  # a few nodes an aggregation
    x, y = data(task)
    model = E.RandomCuts(task, forest, classes).fit(table(spark, x, y))
    plain = [local(x, y, forest, t, classes) for t in range(forest.trees)]
    want = np.array([np.mean([follow(p, r) for p in plain], axis=0) for r in x])
    got = sum(v[E.leaf_of(f, x)] for f, v in zip(model.forest, model.values, strict=True)) / forest.trees
    assert got == pytest.approx(want.reshape(got.shape), abs=1e-9)
    out = sorted(model.transform(table(spark, x, y)).collect(), key=lambda r: r["i"])
    assert [r["prediction"] for r in out] == pytest.approx(got[:, 0] if not classes else got.argmax(axis=1))


def test_seeded_and_unlike_another_seed(spark):
    x, y = data("binary")
    df = table(spark, x, y)
    cuts = lambda seed, d: [f[1].tolist() for f in E.RandomCuts("binary", E.Forest(trees=2, depth=3, seed=seed)).fit(d).forest]
    assert repr(cuts(1, df)) == repr(cuts(1, df.repartition(7))) != repr(cuts(2, df))


@pytest.mark.parametrize("task", ["regression", "binary", "multiclass"])
def test_family_saving_and_attributions(spark, tmp_path, task):
    x, y = data(task)
    df = table(spark, x, y)
    model = T.REGISTRY["extra_trees"].build(task, {"n_trees": 6, "max_depth": 8}, T.facts(df, [f"f{i}" for i in range(5)])).fit(df)
    assert len(model.forest) == 6
    assert T.evaluate(model.transform(df), "rmse" if task == "regression" else "accuracy") < 0.6 if task == "regression" else 0.9 < T.evaluate(model.transform(df), "accuracy")
    persist.save(model, f"{tmp_path}/m")
    found = lambda m: sorted(map(str, m.transform(df).select("i", "prediction").collect()))
    assert found(persist.load(spark, f"{tmp_path}/m")) == found(model)
    k = 2 if task == "multiclass" else 0
    for r in X.attributions(df, model, output=2).limit(20).collect():
        assert sum(r["attribution"]) + r["expected"] == pytest.approx(model.ensemble().outputs(np.array([r["features"].toArray()]))[0, k], abs=1e-9)


def test_odd_tables(spark):
    one = table(spark, np.ones((4, 2)), np.array([1.0, 2.0, 3.0, 6.0]))
    assert {r["prediction"] for r in E.RandomCuts("regression", E.Forest(trees=2)).fit(one).transform(one).collect()} == {3.0}
    none = E.RandomCuts("binary", E.Forest(trees=2)).fit(one.limit(0))
    assert {(r["prediction"], tuple(r["probability"])) for r in none.transform(one).collect()} == {(0.0, (0.5, 0.5))}
    gone = table(spark, np.full((4, 1), np.nan), np.array([0.0, 1.0, 0.0, 1.0]))
    assert {tuple(r["probability"]) for r in E.RandomCuts("binary", E.Forest(trees=2)).fit(gone).transform(gone).collect()} == {(0.5, 0.5)}
    unlabelled = table(spark, np.arange(4.0)[:, None], np.array([0.0, 1.0, 0.0, np.nan]))
    assert sum(E.RandomCuts("binary", E.Forest(trees=1)).fit(unlabelled).cover[0][:1]) == 3
