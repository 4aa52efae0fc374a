"""Percentiles by narrowing are those of a sorted column."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.operators import quantiles as Q

SHARES = [0.0, 0.01, 0.25, 0.5, 0.7, 0.95, 0.99, 1.0]


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [tuple(None if v[i] is None else float(v[i]) for v in columns.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)


def asked(df, shares=SHARES):
    return Q.quantiles(df, {c: (F.col(c), shares) for c in df.columns})


@pytest.mark.parametrize("accuracy, few", [(5000, 1_000_000), (20, 30), (3, 1)])
def test_equal_to_sorting(spark, monkeypatch, accuracy, few):
    """Also with sketches so coarse that brackets are narrowed many times, or cannot be."""
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "COLUMNS", 3)
    rng = np.random.default_rng(3)
    n = 3001
    heavy = np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n))
    some = [None if v < 0.2 else v for v in rng.random(n)]
    df = frame(spark, smooth=rng.normal(size=n), tied=rng.integers(0, 4, n), heavy=heavy, skewed=rng.random(n) ** -3, some=some)
    got = asked(df)
    for c, values in (("smooth", None), ("tied", None), ("heavy", None), ("skewed", None), ("some", None)):
        values = sorted(r[0] for r in df.select(c).where(f"{c} is not null").collect())
        assert got[c] == pytest.approx(np.quantile(values, SHARES).tolist(), rel=1e-12), c
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, SHARES))).alias(c) for c in df.columns]).first().asDict()
    assert got == want


@pytest.mark.parametrize("n", range(1, 8))
def test_few_rows(spark, n):
    values = [float(v * v) for v in range(n)]
    assert asked(frame(spark, v=values))["v"] == pytest.approx(np.quantile(values, SHARES).tolist())


def test_odd_columns(spark):
    df = frame(spark, none=[None] * 4, same=[2.0] * 4, wild=[-math.inf, 1.0, 3.0, math.inf])
    got = asked(df, [0.0, 0.5, 1.0])
    assert got == {"none": None, "same": [2.0] * 3, "wild": [-math.inf, 2.0, math.inf]}
    assert asked(df.limit(0), [0.5]) == {"none": None, "same": None, "wild": None}
    assert Q.quantiles(df, {}) == {}
    nan = asked(frame(spark, v=[1.0, 2.0, math.nan]), [0.5, 1.0])["v"]
    assert nan[0] == 2.0 and math.isnan(nan[1])
