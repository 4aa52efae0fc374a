"""Models outlive their session state and their training data."""

from __future__ import annotations

import shutil

import pytest
from pyspark.ml.feature import VectorAssembler

from lumen.functions import persist
from lumen.operators import training as T
from lumen.operators.features import FeatureTransformer
from lumen.operators.prep import Preprocessor
from lumen.sources import io

SPECS = [
    {"op": "frequency_encode", "params": {"col": "shop"}},
    {"op": "target_encode", "params": {"col": "shop", "smoothing": 2.0}},
    {"op": "group_aggregate", "params": {"by": "shop", "col": "price", "agg": "std"}},
    {"op": "winsorize", "params": {"col": "price"}},
    {"op": "quantile_bin", "params": {"col": "price", "n_bins": 3}},
]


@pytest.fixture
def train(spark, tmp_path):
    """Rows read from a folder that a test may delete."""
    rows = [(i, ["north", "south", None][i % 3], float(i * i % 17), float(i % 2)) for i in range(60)]
    spark.createDataFrame(rows, "id int, shop string, price double, y double").write.parquet(f"{tmp_path}/train")
    return spark.read.parquet(f"{tmp_path}/train")


@pytest.fixture
def batch(spark):
    return spark.createDataFrame([(1, "north", 3.0), (2, "east", None), (3, None, 1e9), (4, "south", float("nan"))], "id int, shop string, price double")


def rows(df):
    return [str(r) for r in df.orderBy("id").collect()]


def test_feature_model_without_its_training_data(spark, tmp_path, train, batch):
    model = FeatureTransformer(SPECS, "y").fit(train)
    model.save(f"{tmp_path}/model")
    before = rows(model.transform(batch))
    shutil.rmtree(tmp_path / "train")
    assert rows(model.transform(batch)) == before
    assert rows(persist.load(spark, f"{tmp_path}/model").transform(batch)) == before
    # saving a loaded model elsewhere, and over an older one
    persist.load(spark, f"{tmp_path}/model").save(f"{tmp_path}/copy")
    FeatureTransformer(SPECS[:1]).fit(batch).save(f"{tmp_path}/model")
    assert rows(persist.load(spark, f"{tmp_path}/copy").transform(batch)) == before
    assert persist.load(spark, f"{tmp_path}/model").output_columns == ["shop_freq"]


def test_preprocessor(spark, tmp_path, train, batch):
    model = Preprocessor(["price"], ["shop"], clipped=["price"], keep=["id"], indicators=True).fit(train)
    model.save(f"{tmp_path}/model")
    again = persist.load(spark, f"{tmp_path}/model")
    assert again.output_columns == model.output_columns
    assert rows(again.transform(batch)) == rows(model.transform(batch))


@pytest.fixture(scope="module")
def points(spark):
    data = [(i, float(i % 7), float(i % 5), float((i % 7) > 3)) for i in range(70)]
    return T.assemble(spark.createDataFrame(data, "id int, a double, b double, y double"), ["a", "b"], "y").cache()


@pytest.mark.parametrize("name", ["logistic_regression", "decision_tree", "random_forest", "naive_bayes", "svm", "knn"])
def test_families(spark, tmp_path, points, name):
    model = T.REGISTRY[name].build("binary", {}, T.facts(points, ["a", "b"])).fit(points)
    persist.save(model, f"{tmp_path}/model")
    want = model.transform(points).select("id", "prediction")
    assert rows(persist.load(spark, f"{tmp_path}/model").transform(points).select("id", "prediction")) == rows(want)


def test_number_of_trees_is_as_asked(points):
    f = T.facts(points, ["a", "b"])
    assert T.REGISTRY["random_forest"].build("binary", {"n_trees": 120}, f).getNumTrees() == 120
    assert T.REGISTRY["xgboost"].build("binary", {"n_trees": 90}, f).growth.rounds == 90
    found = T.search(points.selectExpr("*", "id % 2 AS fold"), ["a", "b"], "random_forest", "binary", "accuracy", trials=2, k=2, max_trees=3)
    assert found.params.get("n_trees", 3) == 3


def test_ensembles(spark, tmp_path, points):
    f = T.facts(points, ["a", "b"])
    makers = [lambda m=m: T.REGISTRY[m].build("binary", {}, f) for m in ("logistic_regression", "naive_bayes")]
    members = [make().fit(points) for make in makers]
    folds = points.selectExpr("*", "id % 2 AS fold")
    for i, model in enumerate((T.VotingModel(members, "binary"), T.stack(folds, makers, members, "binary", 2))):
        model.save(f"{tmp_path}/{i}")
        want = rows(model.transform(points).select("id", "prediction"))
        assert rows(persist.load(spark, f"{tmp_path}/{i}").transform(points).select("id", "prediction")) == want


def test_bundle_scores_a_batch_from_disk(spark, tmp_path, points):
    features = FeatureTransformer([{"op": "product", "params": {"a": "a", "b": "b"}}]).fit(points)
    raw = points.select("id", "a", "b", "y")
    used = ["a", "b", "a_x_b"]
    made = T.assemble(features.transform(raw), used, "y")
    tree = T.REGISTRY["decision_tree"].build("binary", {}, T.facts(made, used)).fit(made)
    steps = [features, VectorAssembler(inputCols=used, outputCol="features", handleInvalid="keep"), tree]
    persist.Bundle(steps, ["a", "b"], ["low", "high"]).save(f"{tmp_path}/bundle")
    raw.write.parquet(f"{tmp_path}/in.parquet")
    io.score_batch(spark, f"{tmp_path}/in.parquet", f"{tmp_path}/bundle", f"{tmp_path}/out", ["a", "b"], "parquet")
    got = spark.read.parquet(f"{tmp_path}/out")
    # the label is a > 3, which a tree finds exactly
    assert got.where("predicted_label IS DISTINCT FROM if(a > 3, 'high', 'low')").count() == 0 and got.count() == 70
    with pytest.raises(ValueError, match="missing input columns: b"):
        persist.load(spark, f"{tmp_path}/bundle").transform(raw.drop("b"))


def test_what_cannot_be_saved_or_loaded(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot be saved"):
        persist.save(object(), f"{tmp_path}/x")
    with pytest.raises(Exception, match="about"):
        persist.load(spark, f"{tmp_path}/x")


def test_baseline_is_read_back(spark, tmp_path, batch):
    io.write_baseline(batch, f"{tmp_path}/base", "price")
    assert io.read_baseline(spark, f"{tmp_path}/base").columns == ["id", "shop"]
