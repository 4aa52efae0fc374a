"""Hand-computed values of the other operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.operators import drift, metrics, prep, significance
from lumen.operators import profile as P
from lumen.operators import training as T
from lumen.plans import semantics
from lumen.sources import io


def test_mcnemar_tails():
    assert significance.mcnemar_p(7, 3) == significance.mcnemar_p(3, 7) == pytest.approx(2 * (1 + 10 + 45 + 120) / 1024)
    assert significance.mcnemar_p(41, 22) == pytest.approx(math.erfc(math.sqrt(18**2 / 63 / 2)))
    assert significance.mcnemar_p(6, 6) == 1.0  # the doubled tail is more than the whole


def test_holm(spark):
    """Against the step-down loop, on drawn values with ties."""
    rng = np.random.default_rng(11)
    for n in (1, 4, 9):
        for _ in range(4):
            ps = (rng.random(n) ** 3).round(2).tolist()
            want, going = {}, True
            for rank, k in enumerate(sorted(range(n), key=lambda k: (ps[k], k))):  # noqa: B023
                going = going and ps[k] <= 0.05 / (n - rank)
                want[k] = going
            df = spark.createDataFrame(list(enumerate(ps)), "k int, p double")
            assert {r["k"]: r["reject"] for r in significance.holm(df, "p", "k").collect()} == want


def test_pareto(spark):
    """Against all pairs of rows, on drawn values with ties and nulls."""
    rng = np.random.default_rng(12)
    rows = [(i, None if i == 5 else float(rng.integers(6)) / 4, None if i == 9 else float(rng.integers(8))) for i in range(40)]
    beats = lambda a, b: None not in a and a[1] >= b[1] and a[2] <= b[2] and a[1:] != b[1:]
    want = {b[0]: None not in b and not any(beats(a, b) for a in rows) for b in rows}
    df = spark.createDataFrame(rows, "i int, s double, l double")
    assert {r["i"]: r["is_optimal"] for r in metrics.pareto(df, "s", "l").collect()} == want


def test_threshold():
    for fp, fn in ((3, 2), (0.25, 0.75), (17, 17)):
        p = metrics.bayes_threshold(fp, fn)
        assert p * fn == pytest.approx((1 - p) * fp)  # acting and waiting cost the same there
    assert metrics.bayes_threshold(-2, 4) == metrics.bayes_threshold(4, float("inf")) == metrics.bayes_threshold("x", 4) == 0.5


def test_bootstrap():
    assert significance.bootstrap_difference([0.62] * 6, [0.37] * 6) == pytest.approx((0.25, 0.25, 0.25))
    rng = np.random.default_rng(21)
    base = rng.uniform(0.6, 0.7, 7)
    leader, tied = significance.ties({"one": list(base), "two": list(base + rng.permutation(np.linspace(-0.02, 0.02, 7))), "far": list(base / 2)})
    assert leader in tied and {"one", "two"} == set(tied)


def test_drift_of_a_table_on_itself_and_of_empty_ones(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(100)], "x double, c string")
    assert {r["psi"] for r in drift.drift_report(df, df).collect()} == {0.0}
    assert {r["psi"] for r in drift.drift_report(df, df.limit(0)).collect()} == {0.0}


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 40, 300) / 40, rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(a > neg).mean() + (a == neg).mean() / 2 for a in pos])
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(want)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None


def test_moments_match_their_definitions(spark):
    x = [1.0, 2.0, 4.0, 4.0, 9.0, 20.0]
    r = P.numeric_stats(spark.createDataFrame([(v,) for v in x], "x double"), ["x"]).first()
    n, m = len(x), np.mean(x)
    g1 = np.mean((x - m) ** 3) / np.mean((x - m) ** 2) ** 1.5
    g2 = np.mean((x - m) ** 4) / np.mean((x - m) ** 2) ** 2 - 3
    assert r["skew"] == pytest.approx(math.sqrt(n * (n - 1)) / (n - 2) * g1)
    assert r["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def test_types_of_a_small_frame(spark):
    rows = [(i, 20.5 + i, ["NYC", "LA", "SF"][i % 3], i % 2, 1000.0 * (i * i % 7) + 0.5 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id int, income double, city string, churn int, price double")
    assert P.semantic_types(df, "churn") == {"row_id": "ID", "income": "NUMERICAL", "city": "CATEGORICAL", "churn": "BINARY", "price": "NUMERICAL"}


def test_preprocessor_replays(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "x double, c string")
    m = prep.Preprocessor(["x"], ["c"], indicators=True).fit(df)
    out = m.transform(spark.createDataFrame([(2.0, "zz"), (None, "a")], "x double, c string")).collect()
    assert m.output_columns == ["x", "x_is_missing", "c_MISSING", "c_a", "c_b"]
    assert [tuple(r) for r in out] == [(0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 1.0, 0.0)]
    assert prep.sanitise(["a[b]", "a_b_", "a<b>"]) == ["a_b_", "a_b___1", "a_b___2"]
    assert prep.sanitise(["a", "a", "a__1"]) == ["a", "a__2", "a__1"]


def test_regularisation_matches_closed_forms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -0.5, 2.0] + rng.normal(0, 0.3, 80)
    df = T.assemble(spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double"), ["a", "b", "c"], "y")
    f = T.facts(df, ["a", "b", "c"])
    got = T.REGISTRY["ridge"].build("regression", {"alpha": 7.0}, f).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(got.coefficients, np.linalg.solve(xc.T @ xc + 7 * np.eye(3), xc.T @ yc), atol=1e-4)


def test_every_family_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    for task, y in (("binary", (x[:, 0] > 0).astype(float)), ("regression", x[:, 0] * 2)):
        df = T.balanced_weights(T.assemble(spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double"), ["a", "b"], "y"))
        f = T.facts(df, ["a", "b"])
        for name in ("knn", "svm") if task == "binary" else ("lasso", "knn"):
            metric = "accuracy" if task == "binary" else "rmse"
            params = {"gamma": 1.0} if name == "svm" else {"alpha": 0.01}
            score = T.evaluate(T.REGISTRY[name].build(task, params, f).fit(df).transform(df), metric)
            assert score > 0.8 if task == "binary" else score < 2
    with pytest.raises(ValueError):
        T.search(df, ["a", "b"], "ft_transformer", "binary", "f1")


def test_stacking_is_direction_aware(spark):
    rows = [T.Result(n, {}, s, 0.0, [s], 0.0, 1.0, None) for n, s in (("a", 3.0), ("b", 1.0), ("c", 2.0))]
    assert [r.model_name for r in T.top(rows, 2, "rmse")] == ["b", "c"]
    assert [r.model_name for r in T.top(rows, 2, "f1")] == ["a", "c"]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "a int, b double")
    df.write.parquet(str(tmp_path / "x.parquet"))
    assert io.load(spark, str(tmp_path / "x.parquet")).where("b is null").count() == 1
    df.write.option("header", True).csv(str(tmp_path / "x.csv"))
    assert io.load(spark, str(tmp_path / "x.csv")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        io.load(spark, "x.xlsx")
    with pytest.raises(ValueError, match="did you mean churn"):
        io.check_target(spark.createDataFrame([(1,)], "churn int"), "chrun")
    assert io.from_rows(spark, {"a": 1}, "a int, b string").first() == (1, None)


def test_semantics():
    assert semantics.sensitive_columns(["age", "mileage", "account_age_days"]) == ["age"]


def test_ranks_span_tasks(spark):
    """Splits and folds in a given order, with a class of most rows, null classes and many tasks."""
    rows = [(i * 7 % 401, "a" if i % 10 else None if i % 20 else "b") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(rows, "id int, c string").repartition(6)
    assert prep._ranked(df, "c", [F.col("id")]).count() == 400
    got = {r["id"]: r["fold"] for r in prep.kfold(df, [F.col("id")], 3, "c").collect()}
    whole = {r["id"]: r["fold"] for r in prep.kfold(df, [F.col("id")], 3).collect()}
    test = {r["id"] for r in prep.stratified(df, "c", [F.col("id")], 0.25).where("is_test").collect()}
    assert [whole[i] for i in sorted(whole)] == [i % 3 for i in range(400)]
    for c in ("a", "b", None):
        ids = sorted(i for i, v in rows if v == c)
        assert [got[i] for i in ids] == [j % 3 for j in range(len(ids))]
        assert {i for i in ids if i in test} == set(ids[: round(len(ids) * 0.25)])
    assert prep.kfold(df.limit(0), [F.col("id")], 3).columns == ["id", "c", "fold"] and prep.kfold(df.limit(0), [F.col("id")], 3).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_label_index_leaves_large_tables_where_they_are(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else "often" if i % 3 else f"v{i % 50:02}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, c string")
    place = {v: i for i, v in enumerate(sorted({v for _, v in rows if v is not None}))}
    want = [(i, v, None if v is None else place[v]) for i, v in rows]
    monkeypatch.setattr(prep, "FREQUENT", 5)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (prep.BROADCAST_CLASSES, 3):
            monkeypatch.setattr(prep, "BROADCAST_CLASSES", most)
            out = prep.label_index(df, "c")
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("SortMergeJoin" in plan) == (most == 3) and "BroadcastHashJoin" in plan
            assert sorted(map(tuple, out.collect())) == want and out.columns == ["id", "c", "label"]
        assert prep.label_index(df.limit(0), "c").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_metric_by_group_is_an_aggregation(spark):
    from lumen.operators import significance

    rows = [("a" if i % 3 else None, float(i), float(i * i % 11)) for i in range(50)]
    got = significance.metric_by_group(spark.createDataFrame(rows, "g string, y double, p double"), "g", "y", "p", lambda y, p: F.max(F.abs(y - p)) + F.count("*"))
    want = {g: max(abs(y - p) for h, y, p in rows if h == g) + sum(h == g for h, _, _ in rows) for g in ("a", None)}
    assert dict(map(tuple, got.collect())) == want
    assert "InArrow" not in got._jdf.queryExecution().executedPlan().toString()
