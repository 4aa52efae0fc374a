"""Mutual information by neighbours, against brute force over all pairs of rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lumen.operators import information as I
from lumen.operators import prep


def plain(x, y, k):
    x, y = np.array(x, float), np.array(y)
    keep = np.array([(y == v).sum() > 1 for v in y])
    x, y, n = x[keep], y[keep], int(keep.sum())
    psi = lambda m: sum(1 / i for i in range(1, int(m))) - 0.5772156649015329
    total = 0.0
    for i in range(n):
        same = np.delete(np.abs(x - x[i]), i)[np.delete(y == y[i], i)]
        kk = min(k, len(same))
        d = np.sort(same)[kk - 1]
        m = (x == x[i]).sum() if d == 0 else (np.abs(x - x[i]) < d).sum()
        total += psi(kk) - psi(len(same) + 1) - psi(m)
    return max(0.0, psi(n) + total / n)


def test_digamma():
    n = np.arange(1, 200)
    assert I.digamma(n) == pytest.approx([sum(1 / i for i in range(1, m)) - 0.5772156649015329 for m in n], abs=1e-12)
    assert I.digamma(np.array([0.5]))[0] == pytest.approx(-0.5772156649015329 - 2 * math.log(2))


@pytest.mark.parametrize("k, parts", [(3, 7), (1, 16), (5, 1)])
def test_against_all_pairs(spark, k, parts):
    rng = np.random.default_rng(k)
    y = rng.choice(["a", "b", "c", "rare", "one"], 500, p=[0.6, 0.25, 0.12, 0.026, 0.004])
    y[0], y[y == "one"] = "one", "a"
    y[0] = "one"
    cols = {"near": (y == "a") * 40 + rng.integers(0, 400, 500), "tied": rng.integers(0, 6, 500), "none": rng.integers(0, 10**6, 500), "hot": np.where(rng.random(500) < 0.4, 7, rng.integers(0, 300, 500))}
    rows = [(*(float(c[i]) for c in cols.values()), str(y[i])) for i in range(500)] + [(None, float("nan"), 1.0, 7.0, None), (None, float("nan"), None, None, "a")]
    df = spark.createDataFrame(rows, [*cols, "y"])
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["feature"]: r["mi"] for r in I.neighbour_information(df, list(cols), "y", k).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == pytest.approx({c: plain(v, y, k) for c, v in cols.items()}, abs=1e-9)


def test_empty_columns_and_selection(spark):
    df = spark.createDataFrame([(float(i), None, "ab"[i > 20]) for i in range(60)], "x double, void double, y string")
    got = I.neighbour_information(df, ["x", "void"], "y")
    assert {r["feature"] for r in got.where("mi = 0").collect()} == {"void"} and prep.select_by_information(got) == ["x"]
    assert [r["mi"] for r in I.neighbour_information(df.limit(0), ["x"], "y").collect()] == [0.0]
    assert [r["mi"] for r in I.neighbour_information(df.limit(1), ["x"], "y").collect()] == [0.0]
