"""From raw rows to a model: refitted folds, held-out rows, tie sets, baselines."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lumen.functions import persist
from lumen.operators import metrics as M
from lumen.operators import run as R
from lumen.operators import significance as S
from lumen.operators import training as T
from lumen.sources import io


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, float(i % 17), ["tin", "wood", "clay.x", None][i % 4], i % 11 / 2, None if i % 9 == 0 else float(i % 5), "warm" if i % 17 + 3 * (i % 4 == 1) > 9 else "cold") for i in range(600)]
    return spark.createDataFrame(rows, "nr int, heat double, stuff string, width double, gap double, feel string").cache()


def test_run_from_raw_rows_to_a_saved_bundle(spark, tmp_path, raw):
    got = R.run(raw, "feel", ["nr"], ["logistic_regression", "decision_tree"], [{"op": "ratio", "params": {"a": "heat", "b": "width"}}])
    assert (got.task, got.labels) == ("binary", ["cold", "warm"]) and sum(got.rows.values()) == 600
    assert min(got.tests.values()) > 0.8 and got.board.count() == 2
    got.model.save(f"{tmp_path}/m")
    fresh = raw.drop("feel").where("nr < 40")
    out = persist.load(spark, f"{tmp_path}/m").transform(fresh)
    assert out.count() == 40 and {r[0] for r in out.select("predicted_label").distinct().collect()} == {"cold", "warm"}
    io.append_metrics(spark, f"{tmp_path}/runs", "one", got.metric, {r.model_name: (r.cv_score, r.latency_ms) for r in got.results})
    io.append_metrics(spark, f"{tmp_path}/runs", "two", got.metric, {"other": (0.5, 1.0)})
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 3


def test_run_of_a_number(raw):
    got = R.run(raw.withColumn("cost", F.col("heat") * 3 + F.col("width")).drop("feel"), "cost", ["nr"], ["ridge"])
    assert (got.task, got.metric, got.labels) == ("regression", "rmse", None)
    assert got.tests["ridge"] < got.baseline and got.tied == ["ridge"]


def test_a_fold_never_sees_the_fold_it_is_scored_on(spark):
    # the category tells the label in its own rows only: encoded on all rows it would be perfect
    rows = spark.createDataFrame([(i, f"c{i}", float((i * 7 // 3) % 2)) for i in range(90)], "nr int, c string, label double").withColumn("fold", F.col("nr") % 3)
    plan = R.Roles([], [], [R.FeatureSpec.of({"op": "target_encode", "params": {"col": "c", "smoothing": 0.0}})])
    scores = T.cross_validate(rows, lambda part: R.Whole(plan, "label", "decision_tree", "binary", keep=["label"]), "accuracy", 3)
    assert max(scores) < 0.8


def test_roles_drop_identifiers_and_the_key(raw):
    found = R.roles(raw.withColumn("owner_id", F.col("nr") * 3), "feel", ["nr"])
    assert found.numeric == ["heat", "width", "gap"] and found.categorical == ["stuff"]


def test_what_a_run_refuses(raw):
    with pytest.raises(ValueError, match="classes"):
        R.run(raw.withColumn("feel", F.lit("x")), "feel", ["nr"])
    for name in R.RESERVED:
        with pytest.raises(ValueError, match=f"renamed: {name}"):
            R.run(raw.withColumn(name, F.lit(1)), "feel", ["nr"])
    with pytest.raises(ValueError, match="feel"):
        R.run(raw, "feeel", ["nr"])


def test_tied_by_paired_draws(spark):
    df = spark.createDataFrame([(i % 2, i % 2 if i % 10 else 1 - i % 2, i % 2 if (i + 5) % 10 else 1 - i % 2, 0) for i in range(2000)], "y int, a int, b int, zero int").cache()
    got = {r["model"]: r for r in S.tied(df, "y", ["a", "b", "zero"], replicates=300).collect()}
    assert got["a"]["tied"] and got["b"]["tied"] and not got["zero"]["tied"]
    assert sum(r["is_leader"] for r in got.values()) == 1 and got["zero"]["low"] > 0.3
    with pytest.raises(ValueError, match="undefined"):
        S.tied(df.select(F.lit(0).alias("y"), F.lit(0).alias("a")), "y", ["a"], "f1", replicates=50)


@pytest.mark.parametrize("metric", S.SUMMED)
def test_tie_set_by_each_metric(spark, metric):
    df = spark.createDataFrame([(i % 3, i % 3 if i % 10 else 1, i % 3 if (i + 5) % 10 else 1, (i + 1) % 3) for i in range(1500)], "y int, a int, b int, off int").cache()
    got = {r["model"]: r for r in S.tied(df, "y", ["a", "b", "off"], metric, replicates=200, labels=[0, 1, 2]).collect()}
    assert got["a"]["tied"] and got["b"]["tied"] and not got["off"]["tied"]
    c = {n: M.classification(df, "y", n).first() for n in ("a", "off")}
    e = {n: M.regression(df, "y", n).first() for n in ("a", "off")}
    want = {"accuracy": c["a"]["accuracy"], "f1_macro": c["a"]["f1_macro"], "rmse": -e["a"]["rmse"], "mae": -e["a"]["mae"]}
    assert metric == "f1" or got["a"]["mean"] == pytest.approx(want[metric], abs=0.01)


def test_baseline_by_the_metric_of_the_run(spark):
    train = spark.createDataFrame([(0.0,)] * 3 + [(1.0,)], "label double")
    test = spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "label double")
    got = {m: T.evaluate(R.constant(train, test, "binary"), m) for m in ("accuracy", "f1", "f1_macro", "roc_auc", "pr_auc")}
    assert got == pytest.approx({"accuracy": 1 / 3, "f1": 0.0, "f1_macro": 0.25, "roc_auc": 0.5, "pr_auc": 2 / 3})
    assert T.evaluate(R.constant(train, test, "regression"), "mae") == pytest.approx((0.25 + 0.75 + 0.75) / 3)


def test_repeated_keys_do_not_multiply_rows(raw):
    got = R.run(raw.withColumn("nr", F.col("nr") % 100), "feel", ["nr"], ["decision_tree", "naive_bayes"], metric="f1_macro")
    assert sum(got.rows.values()) == 600 and got.metric == "f1_macro" and got.tied


def test_baseline_and_log_loss_by_hand(spark):
    df = spark.createDataFrame([(0, [0.5, 0.25, 0.25]), (2, [0.1, 0.8, 0.1]), (None, [1.0, 0.0, 0.0])], "y int, p array<double>")
    want = -(math.log(0.5) + math.log(0.1)) / 2
    assert M.multiclass_log_loss(df.where("y is not null"), "y", "p").first()[0] == pytest.approx(want)
    assert M.multiclass_log_loss(df.where("y is null"), "y", "p").first()[0] == pytest.approx(-math.log(1e-15))
    train, test = spark.createDataFrame([(1.0,), (3.0,)], "y double"), spark.createDataFrame([(2.0,), (5.0,)], "y double")
    assert M.mean_baseline(train, test, "y").first()["mae"] == pytest.approx(1.5)


def test_parts_learn_in_shared_passes_what_each_learns_alone(raw):
    rows = raw.withColumns({"label": (F.col("feel") == "warm").cast("double"), "fold": F.col("nr") * 7 % 13 % 3}).withColumn("wide2", F.col("width") * F.col("nr"))
    plan = R.roles(rows.drop("label", "fold"), "feel", ["nr"], [{"op": "ratio", "params": {"a": "heat", "b": "width"}}, {"op": "product", "params": {"a": "heat", "b": "width"}}, {"op": "log1p", "params": {"col": "heat"}}])
    parts = [F.col("fold") != i for i in range(3)] + [F.lit(True)]
    shared = R.prepare(rows, parts, plan, "binary", [["label"]] * 4)
    for part, got in zip(parts, shared, strict=True):
        alone = R.prepare(rows.where(part), [F.lit(True)], plan, "binary", [["label"]])[0]
        (a, b) = (p.steps[-2].state()[0] for p in (got, alone))
        assert (a["spec"], a["bounds"], a["medians"], a["vocabulary"]) == (b["spec"], b["bounds"], b["medians"], b["vocabulary"])
        assert a["scale"] == pytest.approx(b["scale"]) and got.facts == pytest.approx(alone.facts)


def test_families_share_what_comes_before_them(raw, monkeypatch):
    asked, learn = [], R.fit_parts
    monkeypatch.setattr(R, "fit_parts", lambda df, specs, parts: asked.append(len(parts)) or learn(df, specs, parts))
    R.run(raw, "feel", ["nr"], ["decision_tree", "naive_bayes"], metric="f1")
    assert asked == [4]


def test_ties_do_not_depend_on_where_rows_are(spark):
    df = spark.createDataFrame([(i % 2, i % 2 if i % 10 else 1 - i % 2, i % 2 if (i + 5) % 9 else 1 - i % 2) for i in range(900)], "y int, a int, b int").cache()
    one, two = (sorted(S.tied(df.repartition(n, "a"), "y", ["a", "b"], "f1", replicates=100).collect()) for n in (1, 3))
    assert all(x["mean"] == pytest.approx(y["mean"]) and x["low"] == pytest.approx(y["low"]) for x, y in zip(one, two, strict=True))
