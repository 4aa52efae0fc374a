"""Ordered target statistics and guided search."""

from __future__ import annotations

import hashlib
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.functions import persist
from lumen.operators import ordered as O
from lumen.operators import parzen as P
from lumen.operators import run as R
from lumen.operators import training as T


def plain(rows, prior, strength):
    """(key, category, y) -> key and value, by looking at all earlier rows."""
    place = lambda k: hashlib.md5(f"42|{'' if k is None else k}".encode()).hexdigest()
    out = []
    for k, c, _ in rows:
        seen = [y for k2, c2, y in rows if c2 == c and y is not None and place(k2) < place(k)]
        out.append((k, c, (sum(seen) + strength * prior) / (len(seen) + strength)))
    return out


@pytest.mark.parametrize("bucket_rows", [50_000, 2])
def test_ordered_target_against_all_earlier_rows(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(O, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(1)
    rows = [(None if i % 40 == 0 else i % 150, [None, "a", "b", "b", "b"][rng.integers(5)], None if i % 13 == 0 else int(rng.integers(2))) for i in range(220)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k int, c string, y int, _place string")
    ys = [r[2] for r in rows if r[2] is not None]
    got = O.ordered_target(df, ["c"], "y", ["k"], strength=2.0)
    assert got.columns == ["k", "c", "y", "_place", "c_ordered"]
    by = lambda x: (str(x[0]), str(x[1]), x[2])
    got = sorted(((r["k"], r["c"], round(r["c_ordered"], 9)) for r in got.collect()), key=by)
    assert got == sorted(((k, c, round(v, 9)) for k, c, v in plain(rows, sum(ys) / len(ys), 2.0)), key=by)
    assert O.ordered_target(df.limit(0), ["c"], "y", ["k"]).count() == 0


def test_encoder_replays_all_rows_and_is_saved(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.0), (3, "a", 1.0), (4, None, 1.0)], "k int, c string, y double")
    model, seen = O.OrderedEncoder(["c"], "y", ["k"]).fit_transform(df)
    assert seen.count() == 4 and sorted(r["c_ordered"] for r in seen.where("c is null").collect()) == [0.75]
    persist.save(model, f"{tmp_path}/m")
    new = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    want = {"a": (2 + 0.75) / 4, None: 1.75 / 2, "z": 0.75}
    assert {r["c"]: r["c_ordered"] for r in persist.load(spark, f"{tmp_path}/m").transform(new).collect()} == pytest.approx(want)


def test_an_ordered_encoding_does_not_tell_the_label(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, f"c{i % 300}", float(rng.integers(2))) for i in range(600)], "k int, c string, label double")
    seen = O.ordered_target(rows, ["c"], "label", ["k"])
    assert abs(seen.agg(F.corr("c_ordered", "label")).first()[0]) < 0.2
    replay = O.OrderedEncoder(["c"], "label", ["k"]).fit(rows).transform(rows)
    assert replay.agg(F.corr("c_ordered", "label")).first()[0] > 0.5


SPACE = {"x": (-5.0, 5.0), "rate": ("log", 1e-4, 1.0), "n": (1, 20), "kind": ["a", "b", "c"]}


def hill(p):
    return -((p["x"] - 2) ** 2) - np.log10(p["rate"] / 1e-2) ** 2 * 3 - abs(p["n"] - 7) / 3 - (p["kind"] != "b") * 4


def test_search_is_seeded_and_stays_in_its_space():
    a, b = (P.search(SPACE, hill, 40, batch, seed=3) for batch in (4, 4))
    assert a == b and len(a) == 40 and P.search(SPACE, hill, 40, 4, seed=4) != a
    for p, _ in a:
        assert -5 <= p["x"] <= 5 and 1e-4 <= p["rate"] <= 1.0001 and isinstance(p["n"], int) and 1 <= p["n"] <= 20 and p["kind"] in "abc"


def test_search_beats_random_draws():
    won, gap = 0, []
    for seed in range(20):
        guided = max(s for _, s in P.search(SPACE, hill, 60, 3, seed))
        rng = np.random.default_rng(seed)
        drawn = max(hill(P.random_setting(SPACE, rng)) for _ in range(60))
        won += guided > drawn
        gap.append(guided - drawn)
    assert won >= 16 and np.mean(gap) > 0.3


def test_search_tries_the_first_setting_and_survives_bad_scores():
    got = P.search(SPACE, lambda p: float("nan") if p.get("kind") == "a" else hill(p) if p else -1.0, 25, 2, first={})
    assert got[0] == ({}, -1.0) and all(s == -np.inf for p, s in got if p.get("kind") == "a")
    assert P.search({}, lambda p: 1.0, 1, first={}) == [({}, 1.0)]


def test_a_batch_is_scored_at_once():
    gate = threading.Barrier(3, timeout=20)
    P.search(SPACE, lambda p: gate.wait() * 0.0 + hill(p), 9, 3)


def test_tuning_a_family(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(a), float(a + b > 0.3)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "i int, a double, y double").withColumn("fold", F.col("i") % 3)
    rows = T.assemble(df, ["a"], "y").cache()
    one = T.search(rows, ["a"], "logistic_regression", "binary", "roc_auc", trials=4, batch=2)
    two = T.search(rows, ["a"], "logistic_regression", "binary", "roc_auc", trials=4, batch=2)
    base = T.search(rows, ["a"], "logistic_regression", "binary", "roc_auc", trials=1)
    assert one.params == two.params and one.cv_score == pytest.approx(two.cv_score) and one.cv_score >= base.cv_score and one.latency_ms > 0


def test_categories_of_a_run_by_ordered_statistics(spark, tmp_path):
    rows = [(i, f"c{i % 12}", float(i % 7), "yes" if (i % 12) in (1, 4, 5, 9) or i % 7 == 6 else "no") for i in range(500)]
    df = spark.createDataFrame(rows, "nr int, c string, v double, y string")
    plan = R.roles(df, "y", ["nr"])
    made = df.withColumn("label", (F.col("y") == "yes").cast("double"))
    bundle = R.Whole(plan, "y", "catboost", "binary", {"n_trees": 6, "rate": 0.5}, ["nr", "label"]).fit(made)
    assert "c_ordered" in bundle.steps[0].output_columns
    bundle.save(f"{tmp_path}/b")
    out = persist.load(spark, f"{tmp_path}/b").transform(made)
    assert T.evaluate(out, "accuracy") > 0.9


def test_only_balanced_settings_are_weighted(spark, monkeypatch):
    from lumen.operators import training

    asked = []
    weights = training.balanced_weights
    monkeypatch.setattr(training, "balanced_weights", lambda df: asked.append(1) or weights(df))
    df = training.assemble(spark.createDataFrame([(float(i), float(i % 3 == 0), i % 2) for i in range(40)], "x double, y double, fold int"), ["x"], "y")
    training.search(df, ["x"], "logistic_regression", "binary", "roc_auc", trials=1, k=2)
    assert not asked


def test_the_leaderboard_searches_both_families(spark, sf_dir, monkeypatch):
    from lumen.queries import models

    tried = []
    monkeypatch.setattr(T, "cross_validate", lambda df, make, metric, k: tried.append(make(df)) or [0.5 + len(tried) / 1000] * k)
    got = models.train_leaderboard(spark, sf_dir)
    assert got.count() == 2 and len(tried) == 2 * T.TRIALS
    for kind, name in (("LogisticRegression", "regParam"), ("DecisionTreeClassifier", "maxDepth")):
        assert len({e.getOrDefault(name) for e in tried if type(e).__name__ == kind}) > 2
