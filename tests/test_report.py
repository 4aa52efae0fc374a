"""A whole run with its artifacts, and the parts it is made of."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.sql import functions as F

from lumen.operators import explain as E
from lumen.operators import features as X
from lumen.operators import metrics as M
from lumen.operators import prep, report
from lumen.operators import run as R
from lumen.operators import training as T
from lumen.operators.drift import drift_report


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b), ["x", "y", "z"][i % 3], ["m", "f"][int(rng.integers(2))], "late" if a * 2 + (i % 3 == 0) + rng.normal() * 0.3 > 0.8 else "in time") for i, (a, b) in enumerate(rng.normal(size=(700, 2)))]
    return spark.createDataFrame(rows, "nr int, weight double, noise double, route string, gender string, state string").cache()


def test_complete_run_of_classes(spark, raw, tmp_path):
    got = report.complete(raw, "state", ["nr"], f"{tmp_path}/a", ["decision_tree", "logistic_regression"], metric="f1", honest_folds=2)
    made, model, reference = report.read(spark, f"{tmp_path}/a")
    assert set(made) == set(report.ARTIFACTS) and reference.columns == ["nr", "weight", "noise", "route", "gender"]
    tests, context = made["test_metrics"], made["honest_context"]
    assert tests["model"] == got.outcome.winner and tests["models"][tests["model"]] > 0.75 > context["baseline"]
    assert sum(c["n"] for c in tests["confusion_matrix"]) == context["rows"]["test"] and 0 < tests["roc_auc"] <= 1
    assert context["fastest_tied"] in context["tied"] and abs(context["honest_cv"]["optimism"]) < 0.15
    assert context["honest_cv"]["reported"] == pytest.approx(next(r.cv_score for r in got.outcome.results if r.model_name == tests["model"]))
    assert made["fairness/fairness_report"]["sensitive_columns"] == ["gender"] and len(made["fairness/fairness_report"]["metrics"]["gender"]) == 2
    assert made["semantic_profile"]["gender"]["sensitive"] and made["engineered_features"]["made"]
    assert len(made["pareto_frontier"]) == 2 and any(r["is_pareto_optimal"] for r in made["pareto_frontier"])
    scores, dealt = made["explainability/attributions"]["importance"], made["explainability/permutation"]
    top = max(scores, key=scores.get)
    assert "weight" in top and "weight" in max(dealt, key=dealt.get) and set(scores) == set(dealt) == set(made["feature_selection"]["selected"])
    assert len(made["errors/error_analysis"]["worst"]) == 20 and made["errors/error_analysis"]["slices"]
    assert model.transform(raw.drop("state")).where("predicted_label is null").count() == 0
    assert drift_report(reference, raw.withColumn("weight", F.col("weight") + 3)).where("column = 'weight'").first()["drifted"]


def test_complete_run_of_a_number(spark, raw, tmp_path):
    df = raw.withColumn("cost", F.col("weight") * 5 + F.col("noise")).drop("state")
    got = report.complete(df, "cost", ["nr"], f"{tmp_path}/b", ["ridge", "decision_tree"], honest_folds=2, specs=[{"op": "log1p", "params": {"col": "weight"}}, {"op": "log1p", "params": {"col": "nothing"}}])
    made, _, _ = report.read(spark, f"{tmp_path}/b")
    assert got.outcome.metric == "rmse" and made["test_metrics"]["rmse"] < made["honest_context"]["baseline"]
    assert len(made["engineered_features"]["made"]) == 1 and len(made["engineered_features"]["refused"]) == 1
    assert {"mean", "std"} <= set(made["errors/error_analysis"]["residuals"]) and made["explainability/local"]["weights"]


def test_honest_score_and_elimination(spark, raw):
    rows = T.assemble(raw.withColumns({"y": (F.col("state") == "late").cast("double"), "fold": F.col("nr") % 3}), ["weight", "noise"], "y")
    make = lambda part: C.LogisticRegression()
    got = T.honest_score(rows, make, "accuracy", 0.9, 3)
    assert got["nested"] == pytest.approx(np.mean(T.cross_validate(rows, make, "accuracy", 3))) and got["optimism"] == pytest.approx(0.9 - got["nested"])
    assert T.honest_score(rows, make, "rmse", 0.2, 3)["optimism"] > 0  # an error that is higher when nested
    names = [f"n{i}" for i in range(11)]
    wide = rows.withColumns({c: F.sin(F.col("nr") * (i + 3.7)) for i, c in enumerate(names)})
    fit = lambda part, columns: C.LogisticRegression(regParam=0.01).fit(E._features(part, columns))
    kept = E.eliminate(wide, ["weight", *names], fit, "accuracy")
    assert "weight" in kept and len(kept) < 12 and E.eliminate(wide, names[:5], fit, "accuracy") == names[:5]


def test_proposals_and_names(spark, raw):
    kinds = {"a": "NUMERICAL", "b": "NUMERICAL", "c": "CATEGORICAL", "d": "DATETIME"}
    ops = lambda task: [s.op for s in X.propose(kinds, {"c": 3}, task)]
    assert ops("binary") == ["log1p", "log1p", "datetime_parts", "product", "ratio", "frequency_encode", "target_encode"]
    assert "target_encode" not in ops("multiclass") and X.propose({"c": "CATEGORICAL"}, {"c": 2}, "multiclass") == []
    assert prep.select_names(raw, ["noise", "absent"]).columns == ["noise"] and prep.select_names(raw, ["absent"]).columns == raw.columns


def test_warnings_by_hand(spark):
    assert M.warnings(1000, 0.4, 0.8, 0.79, 0.5, "f1") == []
    assert len(M.warnings(100, 0.1, 0.9, 0.5, 0.6, "f1")) == 4
    assert M.warnings(1000, None, 2.0, 2.2, 5.0, "rmse") == [] and len(M.warnings(1000, None, 2.0, 6.0, 5.0, "rmse")) == 2
    assert M.warnings(1000, None, 0.52, 0.515, 0.5, "roc_auc") == ["no better than the baseline"]
    board = spark.createDataFrame([("a", 0.9, 5.0), ("b", 0.89, 1.0), ("c", 0.1, 0.1)], "model_name string, cv_score double, latency_ms double")
    assert M.fastest(board, ["a", "b"]).first()["model_name"] == "b"


def test_local_and_sampled_explanations_of_a_linear_model(spark, raw):
    from pyspark.ml import regression as Rg

    df = T.assemble(raw.withColumn("y", F.col("weight") * 4 - F.col("noise")), ["weight", "noise"], "y")
    model = Rg.LinearRegression().fit(df)
    near = {r["feature"]: r["weight"] for r in E.local_surrogate(df, model, ["weight", "noise"], {"weight": 0.3, "noise": -1.0}, regression=True).collect()}
    assert near["weight"] == pytest.approx(4, abs=0.1) and near["noise"] == pytest.approx(-1, abs=0.1)
    got = {r["feature"]: r["importance"] for r in E.sampled_shapley(df, model, ["weight", "noise"], ["nr"], regression=True).collect()}
    few = E.sample(df, ["nr"]).toPandas()
    means = df.agg(F.avg("weight"), F.avg("noise")).first()
    assert got == pytest.approx({"weight": 4 * np.abs(few["weight"] - means[0]).mean(), "noise": np.abs(few["noise"] - means[1]).mean()})
    assert E.keep_important({"a": 1.0, "b": 0.0099, "c": 0.01}) == ["a", "c"]


def test_permutation_importance_of_a_known_model(spark, raw):
    from pyspark.ml import regression as Rg

    df = T.assemble(raw.withColumn("y", F.col("weight") * 4), ["weight", "noise"], "y")
    model = Rg.LinearRegression().fit(df)
    got = {r["feature"]: r["importance"] for r in E.permutation_importance(df, model, ["weight", "noise"], ["nr"], "rmse", 2).collect()}
    # dealt anew, values differ by twice their variance
    assert got["weight"] == pytest.approx(4 * np.sqrt(2) * df.agg(F.stddev_pop("weight")).first()[0], rel=0.15) and abs(got["noise"]) < 1e-6


def test_one_metric_throughout(raw):
    got = R.run(raw, "state", ["nr"], ["naive_bayes", "decision_tree"], metric="roc_auc")
    assert got.baseline == 0.5 and got.metric == "roc_auc" and got.winner in got.tied
