"""Model search on pyspark.ml: registry, folds, guided search, ensembles, baselines."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.persist import Saved
from . import metrics as M
from . import parzen
from .boosting import Growth, NewtonBoosting
from .descent import Descent
from .extratrees import Forest, RandomCuts
from .neighbours import NearestNeighbours

#: A search tries ensembles of at most so many trees, and so many settings, unless asked for more.
MAX_TREES, TRIALS = 50, 5
LOWER_IS_BETTER = ("rmse", "mae", "mape")


def task_of(target_type: str, distinct: int) -> str:
    return "regression" if target_type == "NUMERICAL" else "binary" if distinct <= 2 else "multiclass"


def regularised(kind: str, alpha: float, n: int, sd: float, l1_ratio: float = 0.5) -> tuple[float, float]:
    """regParam and elasticNetParam that minimise |r|^2/2n + alpha/n |w|^2/2 (ridge) or + alpha times the mixed penalty (lasso, elastic_net); the solver scales the L2 part by the label's deviation."""
    if kind == "ridge":
        return alpha / n * sd, 0.0
    if kind == "lasso":
        return alpha, 1.0
    a = alpha * l1_ratio + alpha * (1 - l1_ratio) * sd
    return a, (alpha * l1_ratio / a if a else 0.0)


@dataclass(frozen=True)
class Spec:
    """A model family: which tasks it fits, its search space and how to build it."""

    tasks: tuple[str, ...]
    space: dict[str, tuple] = field(default_factory=dict)
    build: Callable[[str, dict, dict], Estimator] | None = None
    note: str = ""


def _log(lo: float, hi: float) -> tuple:
    return ("log", lo, hi)


def _trees(classifier, regressor, **fixed):
    def build(task: str, p: dict, facts: dict) -> Estimator:
        made = {"maxDepth": int(p.get("max_depth", 5)), "minInstancesPerNode": int(p.get("min_leaf", 1)), "seed": facts["seed"]} | fixed
        if "n_trees" in p:
            made["numTrees"] = int(p["n_trees"])
        return (regressor if task == "regression" else classifier)(featuresCol="features", labelCol="label", **made)

    return build


def _boosted(by: str, **fixed):
    """Newton boosting on histograms, grown by level, by leaf or with one split a level."""

    def build(task: str, p: dict, facts: dict) -> Estimator:
        asked = {"rounds": int(p.get("n_trees", 20)), "depth": int(p.get("max_depth", 4 if by != "leaf" else 6)), "rate": float(p.get("rate", 0.1)), "row_share": float(p.get("subsample", 1.0)), "column_share": float(p.get("columns", 1.0)), "leaves": int(p.get("leaves", 31)), "least_rows": int(p.get("min_leaf", fixed.get("least_rows", 1))), "l1": float(p.get("l1", 0.0)), "l2": float(p.get("l2", fixed.get("l2", 1.0)))}
        return NewtonBoosting(task, Growth(by=by, seed=facts["seed"], **(fixed | asked)), facts["classes"])

    return build


def _random_cuts(task: str, p: dict, facts: dict) -> Estimator:
    tried = p.get("tried", 1.0 if task == "regression" else "sqrt")
    return RandomCuts(task, Forest(int(p.get("n_trees", 20)), int(p.get("max_depth", 12)), int(p.get("min_split", 2)), int(p.get("min_leaf", 1)), tried, facts["seed"]), facts["classes"])


def _linear(kind: str):
    def build(task: str, p: dict, facts: dict) -> Estimator:
        reg, mix = regularised(kind, float(p.get("alpha", 1.0)), facts["n"], facts["sd"], float(p.get("l1_ratio", 0.5)))
        return R.LinearRegression(featuresCol="features", labelCol="label", regParam=reg, elasticNetParam=mix, standardization=False, solver="auto")

    return build


def _logistic(task: str, p: dict, facts: dict) -> Estimator:
    return C.LogisticRegression(featuresCol="features", labelCol="label", regParam=1 / (float(p.get("c", 1.0)) * facts["n"]), elasticNetParam=float(p.get("l1_ratio", 0.0)), standardization=False, **({"weightCol": "weight"} if p.get("balanced") else {}))


def _sgd(task: str, p: dict, facts: dict) -> Estimator:
    loss = p.get("loss", "modified_huber") if task != "regression" else "squared_insensitive"
    return Descent(task, loss, facts["classes"], l2=float(p.get("alpha", 1e-4)), seed=facts["seed"])


def _svm(task: str, p: dict, facts: dict) -> Estimator:
    """A squared-hinge machine (squared insensitive for numbers) over the kernel's features."""
    loss = "squared_insensitive" if task == "regression" else "squared_hinge"
    return Descent(task, loss, facts["classes"], l2=1 / (float(p.get("c", 1.0)) * facts["n"]), map={"rbf": "waves", "poly": "products", "linear": "plain"}[p.get("kernel", "rbf")], gamma=float(p.get("gamma", 0.1)), seed=facts["seed"])


def _mlp(task: str, p: dict, facts: dict) -> Estimator:
    if task == "regression":
        return Descent(task, "squared", l2=float(p.get("alpha", 1e-4)), hidden=int(p.get("hidden", 16)), steps=100, seed=facts["seed"])
    return C.MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[facts["width"], int(p.get("hidden", 16)), facts["classes"]], maxIter=60, seed=facts["seed"])


ALL, CLASSES = ("regression", "binary", "multiclass"), ("binary", "multiclass")
REGISTRY: dict[str, Spec] = {
    "logistic_regression": Spec(CLASSES, {"c": _log(1e-4, 1e2), "l1_ratio": (0.0, 1.0), "balanced": [False, True]}, _logistic),
    "ridge": Spec(("regression",), {"alpha": _log(1e-4, 1e3)}, _linear("ridge")),
    "lasso": Spec(("regression",), {"alpha": _log(1e-4, 1e2)}, _linear("lasso")),
    "elastic_net": Spec(("regression",), {"alpha": _log(1e-4, 1e2), "l1_ratio": (0.0, 1.0)}, _linear("elastic_net")),
    "sgd": Spec(ALL, {"alpha": _log(1e-6, 1e-1), "loss": ["modified_huber", "squared_hinge"]}, _sgd, "full-batch descent"),
    "decision_tree": Spec(ALL, {"max_depth": (2, 20), "min_leaf": (1, 20)}, _trees(C.DecisionTreeClassifier, R.DecisionTreeRegressor)),
    "random_forest": Spec(ALL, {"n_trees": (20, MAX_TREES), "max_depth": (3, 12), "min_leaf": (1, 15)}, _trees(C.RandomForestClassifier, R.RandomForestRegressor)),
    "extra_trees": Spec(ALL, {"n_trees": (20, MAX_TREES), "max_depth": (3, 20), "min_split": (2, 30), "min_leaf": (1, 15), "tried": ["sqrt", "log2", 0.5]}, _random_cuts, "depth of 12 unless asked for another"),
    "xgboost": Spec(ALL, {"n_trees": (20, MAX_TREES), "max_depth": (3, 8), "rate": _log(0.02, 0.3), "subsample": (0.6, 1.0), "columns": (0.5, 1.0), "l1": _log(1e-3, 1.0), "l2": _log(0.1, 10.0)}, _boosted("level"), "Newton steps, by level"),
    "lightgbm": Spec(ALL, {"n_trees": (20, MAX_TREES), "leaves": (7, 63), "rate": _log(0.02, 0.3), "subsample": (0.5, 1.0), "min_leaf": (5, 50)}, _boosted("leaf", l2=1e-3, least_hessian=1e-3, least_rows=20), "Newton steps, by leaf within depth 6"),
    "catboost": Spec(ALL, {"n_trees": (20, MAX_TREES), "max_depth": (3, 6), "rate": _log(0.02, 0.3), "l2": _log(1.0, 10.0)}, _boosted("same", l2=3.0), "Newton steps, one split a level; categories by ordered target statistics in a run"),
    "knn": Spec(ALL, {"k": (3, 50)}, lambda task, p, facts: NearestNeighbours(task, int(p.get("k", 5))), "exact, on scaled features"),
    "svm": Spec(ALL, {"c": _log(1e-3, 1e3), "gamma": _log(1e-2, 1.0), "kernel": ["rbf", "poly", "linear"]}, _svm, "random Fourier features; polynomials of degree two"),
    "naive_bayes": Spec(CLASSES, {}, lambda task, p, facts: C.NaiveBayes(featuresCol="features", labelCol="label", modelType="gaussian")),
    "mlp": Spec(ALL, {"hidden": (8, 64)}, _mlp, "one hidden layer, no dropout"),
}
FAST = ("logistic_regression", "ridge", "random_forest", "xgboost", "naive_bayes")
#: Families that need a deep-learning library; asked for, they are skipped with this reason.
UNAVAILABLE = {"tab_transformer": "needs a deep-learning library", "ft_transformer": "needs a deep-learning library"}


def families(task: str, fast: bool = False) -> list[str]:
    return [m for m, s in REGISTRY.items() if task in s.tasks and (not fast or m in FAST)]


def assemble(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """features and label columns beside the rest."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df).withColumn("label", F.col(label).cast("double"))


def facts(df: DataFrame, features: list[str], seed: int = 42) -> dict:
    r = df.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("sd"), F.max("label").alias("top")).first()
    return as_facts(r["n"], r["sd"], r["top"], len(features), seed)


def as_facts(n: int, sd: float | None, top: float | None, width: int, seed: int) -> dict:
    return {"n": max(1, n), "sd": sd or 1.0, "classes": int(top or 0) + 1, "width": width, "seed": seed}


def balanced_weights(df: DataFrame) -> DataFrame:
    """`df` with `weight`: rows of each class weigh the same in total."""
    n = df.groupBy("label").agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return df.join(F.broadcast(n.join(F.broadcast(total)).select("label", (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))), "label")


def positive(df: DataFrame) -> Column:
    """Probability of label 1, or the raw margin through a logistic function where a model has none."""
    if "probability" in df.columns:
        return vector_to_array("probability")[1]
    if "rawPrediction" in df.columns:
        return 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return F.col("prediction")


def evaluate(df: DataFrame, metric: str) -> float:
    """A metric of the scored table (label, prediction, probability): accuracy, f1, f1_macro, roc_auc, pr_auc, rmse, mae or fbeta:<beta>."""
    if metric in ("rmse", "mae"):
        return M.regression(df, "label", "prediction").first()[metric]
    if metric == "roc_auc":
        return M.roc_auc(df.withColumn("_s", positive(df)), "label", "_s").first()[0]
    if metric == "pr_auc":
        return M.average_precision(df.withColumn("_s", positive(df)), "label", "_s").first()[0]
    if metric in ("f1", "accuracy") or metric.startswith("fbeta"):
        beta = float(metric.split(":")[1]) if ":" in metric else 1.0
        r = df.agg(F.count_if(F.expr("label = prediction")).alias("ok"), F.count("*").alias("n"), F.count_if(F.expr("label = 1 AND prediction = 1")).alias("tp"), F.count_if(F.expr("label = 0 AND prediction = 1")).alias("fp"), F.count_if(F.expr("label = 1 AND prediction = 0")).alias("fn")).first()
        if metric == "accuracy":
            return r["ok"] / r["n"] if r["n"] else float("nan")
        below = (1 + beta**2) * r["tp"] + beta**2 * r["fn"] + r["fp"]
        return (1 + beta**2) * r["tp"] / below if below else 0.0
    return M.classification(df, "label", "prediction").first()[metric]


@dataclass
class Result:
    model_name: str
    params: dict
    cv_score: float
    cv_std: float
    fold_scores: list[float]
    train_s: float
    latency_ms: float
    model: Model


def cross_validate(df: DataFrame, make: Callable[[DataFrame], Estimator], metric: str, k: int) -> list[float]:
    """Score on each fold of column `fold`; whatever is learned is learned on the other folds."""
    out = []
    for i in range(k):
        train = df.where(F.col("fold") != i)
        out.append(evaluate(make(train).fit(train).transform(df.where(F.col("fold") == i)), metric))
    return out


def latency(model: Model, rows: DataFrame, calls: int = 10) -> float:
    """Milliseconds of a call on up to 100 rows: the mean of `calls` after one that warms up. The rows are the driver's own, so no scan counts."""
    few = rows.sparkSession.createDataFrame(rows.limit(100).collect(), rows.schema)
    once = lambda: model.transform(few).select("prediction").collect()
    once()
    began = time.perf_counter()
    for _ in range(calls):
        once()
    return (time.perf_counter() - began) * 1000 / calls


def tune(space: dict[str, tuple], folds: Callable[[dict], list[float]], sign: int, trials: int, batch: int = 1, seed: int = 42) -> tuple[float, dict, list[float]]:
    """Mean score, setting and fold scores of the best of some trials, the default setting first; ties to the earlier one."""
    seen: dict[int, list[float]] = {}

    def score(p: dict) -> float:
        seen[id(p)] = folds(p)
        return sign * float(np.mean(seen[id(p)]))

    done = parzen.search(space, score, max(1, trials if space else 1), batch, seed, first={})
    p, best = max(done, key=lambda t: t[1])
    return sign * best, p, seen[id(p)]


def search(df: DataFrame, features: list[str], name: str, task: str, metric: str, trials: int = TRIALS, k: int = 3, seed: int = 42, max_trees: int = MAX_TREES, batch: int = 1) -> Result:
    """Guided search over a family's space by cross-validated score on `df` (features, label, fold); the best setting is fitted on all of it.

    The first setting is the default one; those after it hold up to `max_trees`
    trees. `batch` trials are fitted and scored at once.
    """
    if name in UNAVAILABLE:
        raise ValueError(f"{name}: {UNAVAILABLE[name]}")
    spec = REGISTRY[name]
    if task not in spec.tasks:
        raise ValueError(f"{name} does not fit a {task} task")
    space = spec.space | ({"n_trees": (min(20, max_trees), max_trees)} if "n_trees" in spec.space else {})
    known = facts(df, features, seed)
    # only settings that use weights pay for their join
    rows = lambda p: balanced_weights(df) if p.get("balanced") else df
    sign = -1 if metric in LOWER_IS_BETTER else 1
    best = tune(space, lambda p: cross_validate(rows(p), lambda train: spec.build(task, p, known), metric, k), sign, trials, batch, seed)
    began = time.time()
    model = spec.build(task, best[1], known).fit(rows(best[1]))
    return Result(name, best[1], best[0], float(np.std(best[2])), best[2], time.time() - began, latency(model, df), model)


def leaderboard(spark, results: list[Result], metric: str) -> DataFrame:
    """model_name, cv_score, cv_std, latency_ms, is_pareto_optimal; best first."""
    rows = [(r.model_name, float(r.cv_score), float(r.cv_std), float(r.latency_ms)) for r in results]
    board = spark.createDataFrame(rows, "model_name string, cv_score double, cv_std double, latency_ms double")
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    board = M.pareto(board.withColumn("_g", F.col("cv_score") * sign), "_g", "latency_ms").withColumnRenamed("is_optimal", "is_pareto_optimal")
    return board.orderBy(F.desc("_g"), "model_name").drop("_g")


def top(results: list[Result], n: int, metric: str) -> list[Result]:
    """The n best by the metric's own direction."""
    return sorted(results, key=lambda r: ((1 if metric in LOWER_IS_BETTER else -1) * r.cv_score, r.model_name))[:n]


class VotingModel(Saved, Model):
    """Mean of the members' probabilities, or of their predictions for a regression."""

    def __init__(self, members: list[Model], task: str):
        super().__init__()
        self.members, self.task = members, task

    def state(self):
        return {"task": self.task}, {}, self.members

    @classmethod
    def restore(cls, values, tables, parts):
        return cls(parts, values["task"])

    def _transform(self, df: DataFrame) -> DataFrame:
        out, votes = df, []
        drop = ["prediction", "probability", "rawPrediction", "_lifted"]
        for i, m in enumerate(self.members):
            scored = m.transform(out)
            vote = F.col("prediction") if self.task == "regression" else vector_to_array("probability") if "probability" in scored.columns else F.array(1 - positive(scored), positive(scored))
            out = scored.withColumn(f"_v{i}", vote).drop(*drop)
            votes.append(F.col(f"_v{i}"))
        if self.task == "regression":
            out = out.withColumn("prediction", sum(votes[1:], votes[0]) / len(votes))
        else:
            mean = votes[0]
            for v in votes[1:]:
                mean = F.zip_with(mean, v, lambda a, b: a + b)
            out = out.withColumn("_p", F.transform(mean, lambda a: a / len(votes)))
            out = out.withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).withColumn("probability", array_to_vector("_p")).drop("_p")
        return out.drop(*[f"_v{i}" for i in range(len(self.members))])


class StackingModel(Saved, Model):
    def __init__(self, members: list[Model], meta: Model, task: str):
        super().__init__()
        self.members, self.meta, self.task = members, meta, task

    def state(self):
        return {"task": self.task}, {}, [self.meta, *self.members]

    @classmethod
    def restore(cls, values, tables, parts):
        return cls(parts[1:], parts[0], values["task"])

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.meta.transform(_stack_features(df, self.members, self.task)).drop("_stack")


def _stack_features(df: DataFrame, members: list[Model], task: str) -> DataFrame:
    out, parts = df, []
    for i, m in enumerate(members):
        scored = m.transform(out)
        part = F.array("prediction") if task == "regression" else vector_to_array("probability") if "probability" in scored.columns else F.array(positive(scored))
        out = scored.withColumn(f"_m{i}", part).drop("prediction", "probability", "rawPrediction", "_lifted")
        parts.append(f"_m{i}")
    return out.withColumn("_stack", array_to_vector(F.flatten(F.array(*parts)))).drop(*parts)


def stack(df: DataFrame, makers: list[Callable[[], Estimator]], members: list[Model], task: str, k: int = 3) -> StackingModel:
    """Meta model over out-of-fold outputs: each fold is scored by members that never saw it, where its rows are."""
    folds = [_stack_features(df.where(F.col("fold") == i), [make().fit(df.where(F.col("fold") != i)) for make in makers], task) for i in range(k)]
    rows = folds[0]
    for f in folds[1:]:
        rows = rows.union(f)
    meta = R.LinearRegression(featuresCol="_stack", labelCol="label", regParam=1e-3) if task == "regression" else C.LogisticRegression(featuresCol="_stack", labelCol="label", regParam=1e-3)
    return StackingModel(members, meta.fit(rows.select("_stack", "label")), task)


def honest_score(df: DataFrame, make: Callable[[DataFrame], Estimator], metric: str, reported: float, k: int = 5) -> dict[str, float]:
    """Cross-validation of the winner with everything refitted in each fold, and the optimism of the reported score."""
    nested = float(np.mean(cross_validate(df, make, metric, k)))
    return {"reported": reported, "nested": nested, "optimism": (nested - reported) if metric in LOWER_IS_BETTER else (reported - nested)}
