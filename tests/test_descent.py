"""Data-parallel descent: gradients, optima, calibration."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.functions import persist
from lumen.operators import descent as D
from lumen.operators import metrics as M
from lumen.operators import training as T


@pytest.mark.parametrize("loss", list(D.LOSSES))
@pytest.mark.parametrize("hidden, kind", [(0, "plain"), (0, "products"), (3, "plain")])
def test_gradients_against_differences(loss, hidden, kind):
    rng = np.random.default_rng(1)
    net = D.Net(D.Map(kind), 3, 2, hidden, np.zeros(3), np.ones(3))
    z, y = net.ready(rng.normal(size=(20, 3))), rng.choice([-1.0, 1.0], (20, 2))
    w = rng.normal(size=len(net.start(0)))
    _, g = net.gradient(w, z, y, loss)
    h = 1e-6
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = h
        assert g[i] == pytest.approx((net.gradient(w + e, z, y, loss)[0] - net.gradient(w - e, z, y, loss)[0]) / (2 * h), rel=1e-4, abs=1e-4)


def frame(spark, x, y):
    return T.assemble(spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], ["a", "b", "y"]), ["a", "b"], "y").repartition(2).cache()


def test_squared_loss_reaches_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=300) * 0.1
    model = D.Descent("regression", "squared", l2=0.0).fit(frame(spark, x, y))
    want = np.linalg.lstsq(np.hstack([x, np.ones((300, 1))]), y, rcond=None)[0]
    new = frame(spark, [[1, 0], [0, 1], [0, 0]], [0, 0, 0])
    got = {(r["a"], r["b"]): r["prediction"] for r in model.transform(new).collect()}
    assert got == pytest.approx({(1, 0): want[0] + want[2], (0, 1): want[1] + want[2], (0, 0): want[2]}, abs=1e-3)


@pytest.mark.parametrize("loss", ["modified_huber"])
def test_calibrated_probabilities_beat_raw_margins(spark, loss):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 2))
    y = (rng.random(1500) < 1 / (1 + np.exp(-2.5 * x[:, 0]))).astype(float)
    train, test = frame(spark, x[:1000], y[:1000]), frame(spark, x[1000:], y[1000:])
    error = {}
    for name, calibrate in (("raw", False), ("fitted", True)):
        out = D.Descent("binary", loss, calibrate=calibrate, steps=12).fit(train).transform(test)
        error[name] = M.brier_log_loss(out.withColumn("_p", T.positive(out)), "y", "_p").first()["log_loss"], M.ece(out.withColumn("_p", T.positive(out)), "y", "_p").first()[0]
    assert error["fitted"][0] < error["raw"][0] and error["fitted"][1] < error["raw"][1] and error["fitted"][1] < 0.08


def test_kernels_classes_numbers_and_saving(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, size=(600, 2))
    ring = frame(spark, x, (x**2).sum(axis=1) > 0.5)
    accuracy = {k: T.evaluate(D.Descent("binary", "squared_hinge", map=k, gamma=1.0, calibrate=False, steps=20).fit(ring).transform(ring), "accuracy") for k in ("plain", "waves", "products")}
    assert min(accuracy["waves"], accuracy["products"]) > 0.95 > accuracy["plain"]
    three = frame(spark, x, (x[:, 0] > 0.2).astype(int) + (x[:, 0] > 0.6))
    model = D.Descent("multiclass", "squared_hinge", 3, map="products", steps=15).fit(three)
    out = model.transform(three)
    assert T.evaluate(out, "accuracy") > 0.9 and all(sum(r["probability"]) == pytest.approx(1) for r in out.limit(20).collect())
    persist.save(model, f"{tmp_path}/m")
    same = lambda d: sorted((r["a"], r["prediction"]) for r in d.select("a", "prediction").collect())
    assert same(persist.load(spark, f"{tmp_path}/m").transform(three)) == same(out)
    wave = frame(spark, x, np.sin(3 * x[:, 0]) + x[:, 1])
    for made, most in ((D.Descent("regression", "squared", hidden=12, steps=40), 0.2), (D.Descent("regression", "squared_insensitive", map="waves", gamma=1.0, steps=30), 0.2), (D.Descent("regression", "squared_insensitive", steps=15), 0.6)):
        assert T.evaluate(made.fit(wave).transform(wave), "rmse") < most
    facts = T.facts(wave, ["a", "b"])
    assert all(isinstance(T.REGISTRY[n].build("regression", {}, facts), D.Descent) for n in ("mlp", "svm", "sgd"))


def test_many_partitions_add_up_alike(spark, monkeypatch):
    monkeypatch.setattr(D, "GROUP", 2)
    rng = np.random.default_rng(5)
    df = frame(spark, rng.normal(size=(200, 2)), rng.normal(size=200)).select(F.array("a", "b").alias("x"), F.array("y").alias("y"))
    f = lambda x, y: np.array([x.sum(), y.sum(), len(x)])
    a, b = D._summed(df.repartition(7), 3, f), D._summed(df.coalesce(1), 3, f)
    assert a == pytest.approx(b) and b[2] == 200 and D._summed(df.limit(0), 3, f).tolist() == [0, 0, 0]
