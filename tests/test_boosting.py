"""Newton boosting: against a plain recursion over all rows, and by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lumen.functions import persist
from lumen.operators import boosting as B
from lumen.operators import training as T
from lumen.operators import trees as X


def loss(task, m, y):
    if task == "regression":
        return m - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-m))
    return p - y, p * (1 - p)


def score(g, h, o):
    return max(abs(g) - o.l1, 0) ** 2 / (h + o.l2)


def plain(task, x, y, o):
    """Predictions of exact greedy boosting by level on the values themselves; missing values try both sides."""
    mean = y.mean()
    m = np.full(len(y), math.log(mean / (1 - mean)) if task == "binary" else mean)
    for _ in range(o.rounds):
        g, h = loss(task, m, y)
        step = np.zeros(len(y))

        def grow(rows, depth):
            best = (0.0, None)
            for f in range(x.shape[1]) if depth else []:
                v = x[rows, f]
                for t in sorted(set(v[~np.isnan(v)])):
                    for missing in (False, True) if np.isnan(v).any() else (False,):
                        left = (v <= t) | (np.isnan(v) & missing)
                        a, b = rows[left], rows[~left]
                        if min(len(a), len(b)) < o.least_rows or min(h[a].sum(), h[b].sum()) < o.least_hessian:
                            continue
                        gain = (score(g[a].sum(), h[a].sum(), o) + score(g[b].sum(), h[b].sum(), o) - score(g[rows].sum(), h[rows].sum(), o)) / 2 - o.gamma
                        if gain > best[0] + 1e-12:
                            best = (gain, (a, b))
            if best[1] is None:
                s = g[rows].sum()
                step[rows] = -np.sign(s) * max(abs(s) - o.l1, 0) / (h[rows].sum() + o.l2)
            else:
                for part in best[1]:
                    grow(part, depth - 1)

        grow(np.arange(len(y)), o.depth)
        m = m + o.rate * step
    return m


@pytest.mark.parametrize("task, growth", [
    ("regression", B.Growth(rounds=3, rate=0.5, depth=2)),
    ("regression", B.Growth(rounds=2, rate=0.3, depth=3, l1=2.0, l2=0.5, gamma=0.3, least_rows=7)),
    ("binary", B.Growth(rounds=3, rate=0.5, depth=2, least_hessian=2.0)),
])
def test_against_plain_recursion(spark, task, growth):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, size=(160, 3)).astype(float)
    x[rng.random(160) < 0.15, 1] = np.nan
    y = x[:, 0] * 1.5 + np.nan_to_num(x[:, 1], nan=11) - x[:, 2] / 3 + rng.normal(size=160).round(1)
    y = (y > 9).astype(float) if task == "binary" else y
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, c double, y double").repartition(3)
    df = T.assemble(df, ["a", "b", "c"], "y")
    model = B.NewtonBoosting(task, growth).fit(df)
    margin = lambda r: r["prediction"] if task == "regression" else math.log(r["probability"][1] / r["probability"][0])
    out = {r["i"]: margin(r) for r in model.transform(df).collect()}
    assert [out[i] for i in range(160)] == pytest.approx(plain(task, x, y, growth).tolist(), abs=1e-8)


def test_two_rounds_by_hand(spark):
    df = T.assemble(spark.createDataFrame([(0.0, 1.0), (0.0, 3.0), (1.0, 8.0), (1.0, 12.0)], "a double, y double"), ["a"], "y")
    model = B.NewtonBoosting("regression", B.Growth(rounds=2, rate=0.5, depth=1, l2=1.0)).fit(df)
    # mean 6: sums of y - 6 are -8 and 8, so weights -8/3 and 8/3; then -8 + 2 * 8/6 = -16/3 and weights -16/9 and 16/9
    assert [sorted(t.value[t.feature < 0]) for t in model.ensemble().trees] == [pytest.approx([-8 / 3, 8 / 3]), pytest.approx([-16 / 9, 16 / 9])]
    got = {r["a"]: r["prediction"] for r in model.transform(df).collect()}
    assert got == pytest.approx({0.0: 6 - 4 / 3 - 8 / 9, 1.0: 6 + 4 / 3 + 8 / 9})


def test_leaf_wise_growth_opens_the_greatest_gains(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(a * 3 + (b > 4) * (a > 6) * 40 + rng.normal())) for a, b in rng.integers(0, 10, size=(300, 2))]
    df = T.assemble(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y").cache()
    whole = B.NewtonBoosting("regression", B.Growth(rounds=1, rate=1.0, depth=4, l2=0.0)).fit(df)
    few = B.NewtonBoosting("regression", B.Growth(by="leaf", rounds=1, rate=1.0, depth=4, leaves=4, l2=0.0)).fit(df)
    used = set(few.ensemble().trees[0].leaf_of(np.array([r[:2] for r in rows])))
    assert len(used) == 4
    error = lambda m: T.evaluate(m.transform(df), "rmse")
    shallow = B.NewtonBoosting("regression", B.Growth(rounds=1, rate=1.0, depth=2, l2=0.0)).fit(df)
    assert error(whole) <= error(few) <= error(shallow) + 1e-9


def test_same_split_a_level(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float((a > 4) * 2 + (b > 4) * 3)) for a, b in rng.integers(0, 10, size=(200, 2))]
    df = T.assemble(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    model = B.NewtonBoosting("regression", B.Growth(by="same", rounds=1, rate=1.0, depth=2, l2=0.0)).fit(df)
    t = model.ensemble().trees[0]
    a, b = t.left[0], t.right[0]
    assert (t.feature[a], t.threshold[a]) == (t.feature[b], t.threshold[b]) and {t.feature[0], t.feature[a]} == {0, 1}
    assert T.evaluate(model.transform(df), "rmse") < 1e-9


def test_classes_samples_saving_and_attributions(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float((a > 0) + (a + b > 1))) for a, b in rng.normal(size=(400, 2))]
    df = T.assemble(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y").cache()
    growth = B.Growth(rounds=B.REFRESH + 2, rate=0.4, depth=3, row_share=0.8, column_share=0.5)
    model = B.NewtonBoosting("multiclass", growth, 3).fit(df)
    out = model.transform(df)
    assert T.evaluate(out, "accuracy") > 0.95
    again = B.NewtonBoosting("multiclass", growth, 3).fit(df).transform(df)
    first = lambda d: [r["probability"].tolist() for r in d.select("probability").collect()]
    assert first(out) == first(again) and all(sum(p) == pytest.approx(1) for p in first(out))
    persist.save(model, f"{tmp_path}/m")
    assert first(persist.load(spark, f"{tmp_path}/m").transform(df)) == first(out)
    scored = X.attributions(df, model, output=2).limit(50).collect()
    made = model.ensemble()
    for r in scored:
        assert sum(r["attribution"]) + r["expected"] == pytest.approx(made.outputs(np.array([[r["a"], r["b"]]]))[0, 2], abs=1e-9)


def test_nothing_to_split(spark):
    df = T.assemble(spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, y double"), ["a"], "y")
    assert [r["prediction"] for r in B.NewtonBoosting("regression", B.Growth()).fit(df).transform(df).collect()] == [3.0, 3.0]
    with pytest.raises(ValueError, match="bins"):
        B.NewtonBoosting("binary", B.Growth(bins=300))
