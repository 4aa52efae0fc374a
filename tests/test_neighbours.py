"""Exact nearest neighbours, against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.functions import persist
from lumen.operators import neighbours as N
from lumen.operators import training as T


def plain(x, y, q, k):
    """For each query the k nearest (distance, label), ties by label."""
    return [sorted(zip(np.sqrt(((x - p) ** 2).sum(axis=1)).tolist(), y, strict=True))[:k] for p in q]


def frame(spark, x, y):
    return T.assemble(spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], ["i", "a", "b", "c", "y"]), ["a", "b", "c"], "y")


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 5), (3, 40)])
def test_against_all_distances(spark, monkeypatch, seed, k):
    monkeypatch.setattr(N, "BLOCK", 20)
    monkeypatch.setattr(N, "QUERIES", 7)
    rng = np.random.default_rng(seed)
    # small whole numbers: many equal distances, a third of the rows the same point
    x = np.concatenate([rng.integers(0, 9, (260, 3)), np.tile([4, 4, 4], (140, 1))]).astype(float)
    y = rng.integers(0, 3, len(x))
    q = rng.integers(-3, 12, (60, 3)).astype(float)
    model = N.NearestNeighbours("multiclass", k).fit(frame(spark, x, y))
    assert len(model.pivots) > 5
    m, s = np.array(model.center), np.array(model.scale)
    want = plain((x - m) / s, y.tolist(), (q - m) / s, k)
    rows = spark.createDataFrame([(i, ((p - m) / s).tolist()) for i, p in enumerate(q)], "q long, x array<double>")
    got, pairs = model.neighbours(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r["q"], []).extend([(r["distance"], int(r["y"]))] * r["n"])
    for i, w in enumerate(want):
        assert sorted(by[i]) == w
    out = {r["i"]: r for r in model.transform(frame(spark, q, [0] * len(q))).collect()}
    for i, w in enumerate(want):
        shares = [sum(v == c for _, v in w) / len(w) for c in range(3)]
        assert out[i]["probability"].toArray() == pytest.approx(shares) and out[i]["prediction"] == float(np.argmax(shares))
    assert pairs.first()["looked_at"] <= pairs.first()["pairs"] == len(q) * len(model.pivots)


def test_far_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 50)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.1, (150, 3)) for c in (0, 5, 10, 20)])
    model = N.NearestNeighbours("regression", 3).fit(frame(spark, x, x[:, 0]))
    q = spark.createDataFrame([(i, ((p - np.array(model.center)) / np.array(model.scale)).tolist()) for i, p in enumerate(x[::20])], "q long, x array<double>")
    found, pairs = model.neighbours(q)
    assert found.where("distance = 0").count() == 30
    assert pairs.first()["looked_at"] < pairs.first()["pairs"] / 2


def test_numbers_missing_values_few_rows_and_saving(spark, tmp_path):
    df = frame(spark, [[0, 0, 0], [1, 0, 0], [float("nan"), 0, 0]], [1.0, 3.0, 5.0])
    model = N.NearestNeighbours("regression", 9).fit(df)
    persist.save(model, f"{tmp_path}/m")
    again = persist.load(spark, f"{tmp_path}/m")
    assert {r["prediction"] for r in again.transform(df).collect()} == {3.0} and again.transform(df.limit(0)).count() == 0
    none = N.NearestNeighbours("regression", 3).fit(df.limit(0)).transform(df)
    assert none.where(F.col("prediction").isNull()).count() == 3
