"""From a raw table to a chosen, tested and saved model; every fit learns features, preprocessing and selection from its own rows."""

from __future__ import annotations

import contextlib
import copy
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.persist import Bundle, Saved, written
from ..sources.io import check_target
from . import training as T
from .features import FeatureSpec, FeatureTransformer
from .ordered import OrderedEncoder
from .prep import Preprocessor, drop_null_target, fit_parts, hash_fold, information_of_parts, select_by_information, split
from .profile import class_balance, semantic_types, suggest_metric
from .significance import SUMMED, tied, ties

#: Features are selected only where there are more than so many; a target has at most so many classes.
GATE, CLASSES = 5, 1000
#: Names that a run gives to columns of its own.
RESERVED = ("label", "fold", "is_test", "row_of_run")


@dataclass
class Roles:
    """Columns by the part they play; identifiers and long texts play none."""

    numeric: list[str]
    categorical: list[str]
    specs: list[FeatureSpec] = field(default_factory=list)


def roles(df: DataFrame, target: str, key: list[str], specs: list = (), order: str | None = None) -> Roles:
    """Numbers and the outputs of specs are numeric, categories and flags categorical; dates enter by their parts. The key, identifiers and texts are dropped."""
    used = [c for c in df.columns if c not in key and c != target]
    kinds = semantic_types(df.select(*used), order=None if order not in used else order)
    made = [FeatureSpec.of(s) for s in specs]
    made += [FeatureSpec.of({"op": "datetime_parts", "params": {"col": c}}) for c in used if kinds[c] == "DATETIME"]
    return Roles([c for c in used if kinds[c] == "NUMERICAL"], [c for c in used if kinds[c] in ("CATEGORICAL", "BINARY")], made)


class Assembled(Saved, Model):
    """`features` from columns of any name."""

    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = columns

    def state(self):
        return {"columns": self.columns}, {}, []

    @classmethod
    def restore(cls, values, tables, parts):
        return cls(values["columns"])

    def _transform(self, df: DataFrame) -> DataFrame:
        named = [F.col("`" + c.replace("`", "``") + "`") for c in self.columns]
        return df.withColumn("features", array_to_vector(F.array(*named)))


@dataclass
class Prepared:
    """All that comes before a model, learned: the steps, the raw columns they need and the facts of the rows."""

    steps: list[Model]
    needed: list[str]
    facts: dict

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df


#: Operations whose outputs no row but their own decides; dates must not be texts.
ROWWISE = ("log1p", "ratio", "product", "datetime_parts")


def shared(plan: Roles, df: DataFrame) -> bool:
    """Whether all parts of `df` get the same features, so that what follows can be learned for all of them in the same passes."""
    return all(s.op in ROWWISE and not (s.op == "datetime_parts" and isinstance(df.schema[s.params["col"]].dataType, StringType)) for s in plan.specs)


def prepare(df: DataFrame, parts: list[Column], plan: Roles, task: str, keep: list[list[str]], seed: int = 42) -> list[Prepared]:
    """What each part of `df` (raw rows with `label`) teaches: its own rows only, the passes shared where `shared` allows it. The last part should be the widest."""
    if len(parts) > 1 and not shared(plan, df):
        return [prepare(df.where(p), [F.lit(True)], plan, task, [k], seed)[0] for p, k in zip(parts, keep, strict=True)]
    features = [FeatureTransformer(plan.specs, "label").fit(df.where(p)) for p in parts] if plan.specs else []
    rows, numeric, needed = df, list(plan.numeric), [*plan.numeric, *plan.categorical]
    if features:
        rows, numeric, needed = features[0].transform(df), numeric + features[0].output_columns, needed + features[0].required_columns
    return _learned(rows, parts, [features[i : i + 1] for i in range(len(parts))], numeric, list(plan.categorical), needed, task, keep, seed)


def _learned(rows: DataFrame, parts: list[Column], steps: list[list[Model]], numeric: list[str], categorical: list[str], needed: list[str], task: str, keep: list[list[str]], seed: int) -> list[Prepared]:
    chosen = [numeric] * len(parts)
    if task != "regression" and len(numeric) > GATE:
        scores = information_of_parts(rows, numeric, "label", parts)
        if len(parts) > 1:
            scores = written(scores)
        chosen = [select_by_information(scores.where(F.col("part") == i)) for i in range(len(parts))]
    preps = fit_parts(rows, [Preprocessor(c, categorical, clipped=c, keep=k, indicators=True) for c, k in zip(chosen, keep, strict=True)], parts)
    label = F.col("label").cast("double")
    sums = [e.alias(f"{n}{i}") for i, p in enumerate(parts) for n, e in (("n", F.count_if(p)), ("sd", F.stddev_pop(F.when(p, label))), ("top", F.max(F.when(p, label))))]
    r = rows.agg(*sums).first()
    out = []
    for i, (before, prep) in enumerate(zip(steps, preps, strict=True)):
        shape = Assembled(prep.output_columns)
        out.append(Prepared([*before, prep, shape], list(dict.fromkeys(needed)), T.as_facts(r[f"n{i}"], r[f"sd{i}"], r[f"top{i}"], len(shape.columns), seed)))
    return out


class Whole(Estimator):
    """A model family with all that comes before it; `fit` takes raw rows with `label` and gives a Bundle. `before` is what `prepare` learned of the same rows, if it did, and `made` their label and features."""

    def __init__(self, plan: Roles, target: str, name: str, task: str, params: dict | None = None, keep: list[str] = (), seed: int = 42, before: Prepared | None = None, made: DataFrame | None = None):
        super().__init__()
        self.plan, self.target, self.name, self.task, self.setting, self.keep, self.seed, self.before, self.made = plan, target, name, task, params or {}, list(keep), seed, before, made

    @staticmethod
    def encodes(name: str, plan: Roles, task: str) -> bool:
        """Whether the family has categories of its training rows encoded in another way than those of new rows."""
        return name == "catboost" and bool(plan.categorical) and task != "multiclass"

    def _fit(self, df: DataFrame) -> Bundle:
        if not self.encodes(self.name, self.plan, self.task):
            got = self.before or prepare(df, [F.lit(True)], self.plan, self.task, [self.keep], self.seed)[0]
            made = got.transform(df.withColumn("label", F.col("label").cast("double"))) if self.made is None else self.made
        else:
            steps, numeric, needed = [], list(self.plan.numeric), [*self.plan.numeric, *self.plan.categorical]
            if self.plan.specs:
                features = FeatureTransformer(self.plan.specs, "label").fit(df)
                df, numeric, needed = features.transform(df), numeric + features.output_columns, needed + features.required_columns
                steps.append(features)
            ordered, df = OrderedEncoder(list(self.plan.categorical), "label", seed=self.seed).fit_transform(df)
            steps.append(ordered)
            got = _learned(df, [F.lit(True)], [steps], numeric + ordered.output_columns, [], needed, self.task, [self.keep], self.seed)[0]
            made = df.withColumn("label", F.col("label").cast("double"))
            for step in got.steps[len(steps) :]:
                made = step.transform(made)
        model = T.REGISTRY[self.name].build(self.task, self.setting, got.facts).fit(T.balanced_weights(made) if self.setting.get("balanced") else made)
        return Bundle([*got.steps, model], got.needed)


def serving(fitted: Bundle, keep: list[str], labels: list[str] | None) -> Bundle:
    """The bundle as it is used on new rows: keeps `keep` only, needs no label, and names the classes."""
    steps = []
    for step in fitted.steps:
        if hasattr(step, "vocabulary"):
            step = copy.copy(step)
            step.spec = copy.copy(step.spec)
            step.spec.keep = list(keep)
        steps.append(step)
    return Bundle(steps, [*keep, *fitted.columns], labels)


def constant(train: DataFrame, test: DataFrame, task: str) -> DataFrame:
    """The test rows as one who knows only the training labels would score them: their mean, or the most frequent class and the classes' shares."""
    if task == "regression":
        return test.withColumn("prediction", F.lit(train.agg(F.avg("label")).first()[0]))
    counts = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}
    total, most = sum(counts.values()), min(counts, key=lambda c: (-counts[c], c))
    shares = array_to_vector(F.array(*[F.lit(counts.get(c, 0) / total) for c in range(max(2, max(counts) + 1))]))
    return test.withColumns({"prediction": F.lit(float(most)), "probability": shares})


@dataclass
class Outcome:
    """What a run found; `tests` and `tied` are of the held-out rows. `fitted`, `train` and `test` are as the run used them, with its columns RESERVED."""

    task: str
    metric: str
    labels: list[str] | None
    results: list[T.Result]
    board: DataFrame
    model: Bundle
    tests: dict[str, float]
    baseline: float
    tied: list[str]
    rows: dict[str, int]
    winner: str
    plan: Roles
    fitted: dict[str, Bundle]
    train: DataFrame
    test: DataFrame


def run(df: DataFrame, target: str, key: list[str], names: list[str] | None = None, specs: list = (), metric: str | None = None, trials: int = 1, folds: int = 3, is_test: Column | None = None, seed: int = 42, batch: int = 1) -> Outcome:
    """Split, cross-validate each family on raw rows, fit the best, test all on the held-out rows.

    Rows without a target are left out. `is_test` marks the held-out rows; without
    it a hash of the key does. `trials` settings a family, the first the default one,
    those after it proposed by the trials so far, `batch` of them at once. The baseline (the most frequent class, or the mean) and the ties are
    judged by the run's own metric: `tied` holds the models that may equal the
    leader, on the held-out rows where sums over rows give the metric and else on
    the folds. Columns named in RESERVED are refused; `label` may be the target.
    """
    check_target(df, target)
    taken = [c for c in RESERVED if c in df.columns and not (c == target == "label")]
    if taken:
        raise ValueError(f"columns that must be renamed: {', '.join(taken)}")
    rows = drop_null_target(df, target)
    rows = rows.withColumn("is_test", is_test) if is_test is not None else split(rows, key, seed=seed)
    kind = semantic_types(rows.select(target), target)[target]
    labels = None
    if kind == "NUMERICAL":
        task, found = "regression", suggest_metric(kind, 0, 1.0)
        rows = rows.withColumn("label", F.col(target).cast("double"))
    else:
        balance = class_balance(rows, target).orderBy("value").limit(CLASSES + 1).collect()
        if not 2 <= len(balance) <= CLASSES:
            raise ValueError(f"{target!r} has {len(balance)} classes; 2 to {CLASSES} are needed")
        labels = [r["value"] for r in balance]
        task, found = T.task_of(kind, len(labels)), suggest_metric(kind, len(labels), balance[0]["imbalance"])
        at = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
        rows = rows.withColumn("label", at[F.col(target).cast("string")])
    metric = metric or found
    # a row's own number, as keys may repeat
    rows = written(hash_fold(rows, key, folds, seed).withColumn("row_of_run", F.monotonically_increasing_id()))
    train, test = rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test")
    plan = roles(train.drop("fold", "row_of_run", *([] if target == "label" else ["label"])), target, key, specs)
    sign = -1 if metric in T.LOWER_IS_BETTER else 1
    results, fitted, took_by = [], {}, {}
    names = names or T.families(task, fast=True)
    kept = list(dict.fromkeys([*key, "label", "row_of_run"]))
    # every family and setting stands on the same rows, so what comes before the models is learned once for each fold and once for all rows
    before = prepare(train, [*[F.col("fold") != i for i in range(folds)], F.lit(True)], plan, task, [["label"]] * folds + [kept], seed) if not all(Whole.encodes(n, plan, task) for n in names) else [None] * (folds + 1)
    plain = [n for n in names if not Whole.encodes(n, plan, task)]

    @contextlib.contextmanager
    def features(i: int):
        """Label and features of a fold's training rows (of all, for the last i), held while the families read them, each several times."""
        rows = (train.where(F.col("fold") != i) if i < folds else train).withColumn("label", F.col("label").cast("double"))
        made = before[i].transform(rows).select("label", "features").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield made
        finally:
            made.unpersist()

    # the first setting of all families, fold by fold
    default: dict[str, list[float]] = {name: [] for name in plain}
    for i in range(folds if plain else 0):
        with features(i) as made:
            for name in plain:
                fitted_i = Whole(plan, target, name, task, {}, ["label"], seed, before[i], made).fit(train)
                default[name].append(T.evaluate(fitted_i.transform(train.where(F.col("fold") == i)), metric))

    def search(name: str):
        def score(p: dict) -> list[float]:
            if not p and name in default:
                return default[name]
            steps = iter(before[:-1])
            return T.cross_validate(train, lambda part: Whole(plan, target, name, task, p, ["label"], seed, next(steps)), metric, folds)

        return T.tune(T.REGISTRY[name].space, score, sign, trials, batch, seed)

    found_by = {name: search(name) for name in names}
    with features(folds) if plain else contextlib.nullcontext() as made:
        for name in names:
            began = time.time()
            fitted[name] = Whole(plan, target, name, task, found_by[name][1], kept, seed, before[-1], made if name in plain else None).fit(train)
            took_by[name] = time.time() - began
    for name, (mean, setting, scores) in found_by.items():
        model, took = fitted[name], took_by[name]
        results.append(T.Result(name, setting, mean, float(np.std(scores)), scores, took, T.latency(model, test), model))
    tests = {name: T.evaluate(m.transform(test), metric) for name, m in fitted.items()}
    winner = T.top(results, 1, metric)[0].model_name
    baseline = T.evaluate(constant(train, test, task), metric)
    same = [winner]
    if len(fitted) > 1 and metric in SUMMED:
        # each model in turn, on the rows as they were: no join of their predictions
        raw = list(dict.fromkeys(c for m in fitted.values() for c in m.columns))
        both = test.select("label", F.array().cast("array<double>").alias("said"), F.struct(*[F.col(f"`{c}`") for c in raw]).alias("raw"))
        for m in fitted.values():
            rows = both.select("raw.*", F.struct("raw", "label", "said").alias("row_of_run"))
            both = serving(m, ["row_of_run"], None).transform(rows).select("row_of_run.raw", "row_of_run.label", F.array_append("row_of_run.said", F.col("prediction")).alias("said"))
        both = both.select("label", *[F.col("said")[i].alias(name) for i, name in enumerate(fitted)])
        same = sorted(r["model"] for r in tied(both, "label", list(fitted), metric, seed=seed, labels=range(len(labels or ()))).where("tied").collect())
    elif len(fitted) > 1:
        same = ties({r.model_name: r.fold_scores for r in results}, seed=seed, lower=metric in T.LOWER_IS_BETTER)[1]
    sizes = {"train": train.count(), "test": test.count()}
    return Outcome(task, metric, labels, results, T.leaderboard(df.sparkSession, results, metric), serving(fitted[winner], key, labels), tests, baseline, same, sizes, winner, plan, fitted, train, test)
