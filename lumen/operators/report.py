"""A run with all it has to say: profile, proposed features, search, honest score, warnings, errors, fairness, explanations, written as artifacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import is_numeric
from ..functions.persist import frozen, load
from ..plans.semantics import leakage_suspects, sensitive_columns
from ..sources.io import read_artifact, read_baseline, write_artifact, write_baseline
from . import explain as E
from . import metrics as M
from . import profile as P
from . import run as R
from . import training as T
from . import trees
from .features import FeatureSpec, output_names, propose, triage

ARTIFACTS = ("profile", "semantic_profile", "engineered_features", "feature_selection", "pareto_frontier", "test_metrics", "honest_context", "errors/error_analysis", "fairness/fairness_report", "explainability/attributions", "explainability/permutation", "explainability/local")
#: Rows of an artifact's lists; the tables behind them have all.
SHOWN = 1000


@dataclass
class Report:
    outcome: R.Outcome
    artifacts: dict[str, dict | list]


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.limit(SHOWN).collect()]


def _profiled(df: DataFrame, target: str, key: list[str]) -> tuple[dict, dict, dict[str, str]]:
    used = [c for c in df.columns if c not in key]
    kinds = P.semantic_types(df.select(*used), target)
    numeric = [c for c in used if is_numeric(df, c)]
    categories = [c for c in used if kinds[c] in ("CATEGORICAL", "BINARY") and c not in numeric]
    about = {"overview": _rows(P.overview(df)), "numeric": _rows(P.numeric_stats(df, numeric)) if numeric else [], "categorical": _rows(P.categorical_stats(df, categories)) if categories else []}
    sensitive, suspects = sensitive_columns(used), leakage_suspects(used, target)
    meaning = {c: {"type": kinds[c], "sensitive": c in sensitive, "leakage_suspect": c in suspects} for c in used}
    return about, meaning, kinds


def _tests(scored: DataFrame, task: str) -> dict:
    if task == "regression":
        return M.regression(scored, "label", "prediction").first().asDict()
    out = M.classification(scored, "label", "prediction").first().asDict()
    out["confusion_matrix"] = _rows(M.confusion(scored, "label", "prediction").orderBy("y", "p"))
    rows = scored.withColumn("_p", T.positive(scored))
    if task == "binary":
        for part in (M.roc_auc, M.average_precision, M.brier_log_loss, M.ece):
            out |= part(rows, "label", "_p").first().asDict()
    elif "probability" in scored.columns:
        out |= M.multiclass_log_loss(scored.withColumn("_a", vector_to_array("probability")), "label", "_a").first().asDict()
    return out


def _errors(scored: DataFrame, task: str, columns: list[str]) -> dict:
    if task == "regression":
        loss = F.abs(F.col("label") - F.col("prediction"))
        return {"worst": _rows(M.worst(scored, loss, ["row_of_run"]).select("row_of_run", "label", "prediction", "loss")), "residuals": M.residuals(scored, "label", "prediction").first().asDict()}
    right = F.col("label") == F.col("prediction")
    p = T.positive(scored) if task == "binary" else F.when(right, 1.0).otherwise(0.0)
    loss = M.log_loss_of(F.col("label"), p) if task == "binary" else F.when(right, 0.0).otherwise(1.0)
    return {"worst": _rows(M.worst(scored, loss, ["row_of_run"]).select("row_of_run", "label", "prediction", "loss")), "confused": _rows(M.confused_pairs(scored, "label", "prediction")), "slices": _rows(M.slices(scored, columns, right)) if columns else []}


def _fairness(scored: DataFrame, task: str, sensitive: list[str]) -> dict:
    by = {c: _rows((M.fairness_regression if task == "regression" else M.fairness)(scored, c, "label", "prediction")) for c in sensitive}
    names = ("flag",) if task == "regression" else ("di_flag", "gap_flag")
    return {"sensitive_columns": sensitive, "metrics": by, "flags": [c for c, rows in by.items() if any(r[n] for r in rows for n in names)]}


def _explained(got: R.Outcome, scored: DataFrame, metric: str, seed: int) -> tuple[dict, dict, dict]:
    """Attributions (of trees exactly, else by sampled orders), permutation importance and a local fit, by the columns that the model sees."""
    steps = got.fitted[got.winner].steps
    model, columns = steps[-1], steps[-2].columns
    safe, regression = [f"f{i}" for i in range(len(columns))], got.task == "regression"
    x = vector_to_array("features")
    rows = frozen(scored.select("row_of_run", "label", *[x[i].alias(c) for i, c in enumerate(safe)]))
    named = lambda df, value: {columns[int(r["feature"][1:])]: r[value] for r in df.collect()}
    if hasattr(model, "ensemble") or hasattr(model, "featureImportances"):
        how, found = "trees", trees.importance(E._features(rows, safe), model, safe)
    else:
        how, found = "sampled", E.sampled_shapley(rows, model, safe, ["row_of_run"], seed=seed, regression=regression)
    scores = named(found, "importance")
    one = E.sample(rows, ["row_of_run"], 1, seed).first().asDict()
    near = named(E.local_surrogate(rows, model, safe, one, seed=seed, regression=regression), "weight")
    return {"method": how, "importance": scores, "kept": E.keep_important(scores)}, named(E.permutation_importance(rows, model, safe, ["row_of_run"], metric, 1, seed), "importance"), {"row": one["row_of_run"], "weights": near}


def complete(df: DataFrame, target: str, key: list[str], folder: str, names: list[str] | None = None, specs: list | None = None, metric: str | None = None, trials: int = 1, sensitive: list[str] | None = None, is_test: Column | None = None, seed: int = 42, honest_folds: int = 5) -> Report:
    """A run (see `run.run`) and its artifacts, written below `folder` with the model and the training features.

    Without `specs`, those that the profile suggests are used; unusable ones are
    left out with their reasons. Sensitive columns are found by name unless given.
    The winner is cross-validated again with everything refitted, on other folds.
    """
    rows = df.na.drop(subset=[target])
    about, meaning, kinds = _profiled(rows, target, key)
    if specs is None:
        distinct = {r["column"]: r["n_unique"] for r in about["overview"]}
        plain = {c: k for c, k in kinds.items() if c != target}
        task = T.task_of(kinds[target], distinct[target])
        specs = [s for s in propose(plain, distinct, task) if s.op != "datetime_parts"]  # a run adds those itself
    usable, refused = triage(list(specs), [c for c in rows.columns if c not in (*key, target)])
    got = R.run(rows, target, key, names, usable, metric, trials, is_test=is_test, seed=seed)
    kept = list(dict.fromkeys(["row_of_run", *[c for c in rows.columns if c not in key and c != "label"]]))
    scored = frozen(got.fitted[got.winner].transform(got.test).select("row_of_run", "label", "prediction", "features", *(["probability"] if got.task != "regression" else [])).join(got.test.select(*kept), "row_of_run"))
    best = next(r for r in got.results if r.model_name == got.winner)
    other = R.hash_fold(got.train.drop("fold"), ["row_of_run"], honest_folds, seed + 1)
    honest = T.honest_score(other, lambda part: R.Whole(got.plan, target, got.winner, got.task, best.params, ["label"], seed), got.metric, best.cv_score, honest_folds)
    minority = M.class_shares(got.train, "label").first()["minority"] if got.task != "regression" else None
    notes = M.warnings(sum(got.rows.values()), minority, best.cv_score, got.tests[got.winner], got.baseline, got.metric)
    quick = M.fastest(got.board, got.tied).first()["model_name"]
    steps = got.fitted[got.winner].steps
    columns = steps[-2].columns
    attributions, permutation, local = _explained(got, scored, got.metric, seed)
    sensitive = [c for c in meaning if meaning[c]["sensitive"] and c != target] if sensitive is None else sensitive
    made = {
        "profile": about,
        "semantic_profile": meaning,
        "engineered_features": {"made": [{"op": s.op, "params": s.params, "new_columns": list(output_names(s))} for s in map(FeatureSpec.of, usable)], "refused": [{"spec": getattr(s, "to_dict", lambda s=s: s)(), "reasons": why} for s, why in refused]},
        "feature_selection": {"selected": columns, "important": attributions["kept"], "removed": [c for c in columns if c not in attributions["kept"]]},
        "pareto_frontier": [r | {"tied_with_leader": r["model_name"] in got.tied} for r in _rows(got.board)],
        "test_metrics": {"model": got.winner, "metric": got.metric, "models": got.tests} | _tests(scored, got.task),
        "honest_context": {"baseline": got.baseline, "warnings": notes, "tied": got.tied, "fastest_tied": quick, "honest_cv": honest, "rows": got.rows, "task": got.task},
        "errors/error_analysis": _errors(scored, got.task, [c for c in got.plan.numeric + got.plan.categorical if c in scored.columns]),
        "fairness/fairness_report": _fairness(scored, got.task, sensitive),
        "explainability/attributions": attributions,
        "explainability/permutation": permutation,
        "explainability/local": local,
    }
    for name, content in made.items():
        write_artifact(f"{folder}/{name}.json", content)
    write_baseline(got.train.drop("label", *R.RESERVED), f"{folder}/reference_data.parquet", target if target != "label" else None)
    got.model.save(f"{folder}/model")
    return Report(got, made)


def read(spark, folder: str) -> tuple[dict, object, DataFrame]:
    """The artifacts, the model and the training features that `complete` wrote."""
    return {name: read_artifact(f"{folder}/{name}.json") for name in ARTIFACTS}, load(spark, f"{folder}/model"), read_baseline(spark, f"{folder}/reference_data.parquet")
