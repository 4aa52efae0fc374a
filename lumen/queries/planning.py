"""Task texts to plans; the expected rows are written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import semantics
from ..plans import task_text as T
from .registry import query

#: text, capacity, latency, fp, fn, interpretable, forecast, protected, objective
CASES = [
    ("our two agents can phone 340 households before the campaign ends", 340, None, 1, 1, False, False, "", "rank"),
    ("send us the top 75 machines to service", 75, None, 1, 1, False, False, "", "rank"),
    ("the lab can inspect 12 samples", 12, None, 1, 1, False, False, "", "rank"),
    ("there is room for 2,500 parcels", 2500, None, 1, 1, False, False, "", "rank"),
    ("the panel wants a list of 8 essays", 8, None, 1, 1, False, False, "", "rank"),
    ("the nurses handle 45 patients per shift", 45, None, 1, 1, False, False, "", "rank"),
    ("we mail 500 letters per week", 500, None, 1, 1, False, False, "", "rank"),
    ("keep the top 15% of orchards", None, None, 1, 1, False, False, "", "rank"),
    ("how many buses are needed over the next 6 weeks", None, None, 1, 1, False, True, "", "estimate"),
    ("the budget allows up to €900", None, None, 1, 1, False, False, "", "classify"),
    ("the api replies within 35 milliseconds", None, 35, 1, 1, False, False, "", "classify"),
    ("serving may take 4 seconds", None, 4000, 1, 1, False, False, "", "classify"),
    ("training may take 3 minutes", None, None, 1, 1, False, False, "", "classify"),
    ("the gate decides in real time", None, 100, 1, 1, False, False, "", "classify"),
    ("an overlooked leak is 7 times as bad as a needless dig", None, None, 1, 7, False, False, "", "classify"),
    ("a false alarm is 4x as bad as a missed leak", None, None, 4, 1, False, False, "", "classify"),
    ("false alarms are quite costly in a hospital", None, None, 3, 1, False, False, "", "classify"),
    ("the inspectors must not miss a cracked beam", None, None, 1, 10, False, False, "", "classify"),
    ("the rejected applicants get reason codes", None, None, 1, 1, True, False, "", "classify"),
    ("predictions have to be transparent", None, None, 1, 1, True, False, "", "classify"),
    ("model the tide one day ahead", None, None, 1, 1, False, True, "", "estimate"),
    ("religion and marital status must play no part", None, None, 1, 1, False, False, "religion,marital_status", "classify"),
    ("no use of postal codes, ethnicity or disability", None, None, 1, 1, False, False, "zip_code,ethnicity,disability", "classify"),
    ("the voltage of the average package", None, None, 1, 1, False, False, "", "classify"),
    ("leave out date of birth and genetic markers", None, None, 1, 1, False, False, "age,genetic_information", "classify"),
    ("prioritise repairs of water mains", None, None, 1, 1, False, False, "", "rank"),
    ("estimate the weight of a harvest", None, None, 1, 1, False, False, "", "estimate"),
    ("flag broken seals", None, None, 1, 1, False, False, "", "classify"),
    ("", None, None, 1, 1, False, False, "", "classify"),
    (None, None, None, 1, 1, False, False, "", "classify"),
]


def _sql(v) -> str:
    if v is None:
        return "NULL"
    return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


_ROWS = ", ".join(f"({i}, {', '.join(map(_sql, c))})" for i, c in enumerate(CASES))


@query("plan_text", f"SELECT i, capacity_k, CAST(latency_ms AS DOUBLE) AS latency_ms, CAST(cost_fp AS DOUBLE) AS cost_fp, CAST(cost_fn AS DOUBLE) AS cost_fn, interpretable, forecast, protected, objective FROM (VALUES {_ROWS}) AS v(i, t, capacity_k, latency_ms, cost_fp, cost_fn, interpretable, forecast, protected, objective)")
def plan_text(spark, d):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    return T.plan(df).select("i", "capacity_k", "latency_ms", "cost_fp", "cost_fn", "interpretable", "forecast", F.array_join("protected", ",").alias("protected"), "objective")


#: text, task, imbalance, metric, metric of the search, beta squared
METRICS = [
    ("the crew can visit 60 wells", "binary", 0.4, "precision_at_k", "f1", 1),
    ("which pumps will stop", "binary", 0.02, "pr_auc", "roc_auc", 1),
    ("which pumps will stop", "binary", 0.2, "roc_auc", "roc_auc", 1),
    ("which pumps will stop", "binary", 8.0, "roc_auc", "roc_auc", 1),
    ("which pumps will stop", "binary", 0.6, "f1", "f1", 1),
    ("which pumps will stop", "binary", 0.9, "accuracy", "accuracy", 1),
    ("which pumps will stop", "binary", None, "roc_auc", "roc_auc", 1),
    ("an overlooked leak is 6x as bad as a needless dig", "binary", 0.5, "fbeta", "fbeta", 6),
    ("an overlooked leak is 6x as bad as a needless dig", "multiclass", None, "f1_macro", "f1_macro", 6),
    ("the depth of a well", "regression", None, "rmse", "rmse", 1),
    ("the depth of a well, robust to odd readings", "regression", None, "mae", "rmse", 1),
    ("which pumps will stop", None, None, "f1_macro", "f1_macro", 1),
]


@query("plan_metric", "SELECT i, metric, search_metric, sqrt(CAST(b AS DOUBLE)) AS beta, round(1e0 / (1 + b), 6) AS threshold FROM (VALUES " + ", ".join(f"({i}, '{m}', '{s}', {b})" for i, (_, _, _, m, s, b) in enumerate(METRICS)) + ") AS v(i, metric, search_metric, b)")
def plan_metric(spark, d):
    df = spark.createDataFrame([(i, t, k, r) for i, (t, k, r, *_) in enumerate(METRICS)], "i int, text string, task string, imbalance double")
    out = T.plan(df).select("i", *T.resolve(F.col("task"), F.col("imbalance")))
    return out.select("i", "metric", "search_metric", "beta", F.round("threshold", 6).alias("threshold"))


@query("plan_semantics", "SELECT * FROM (VALUES ('driver_age', true, false), ('engine_age_days', false, false), ('genderOfOwner', true, false), ('stopped_at', false, true), ('tonnage', false, false)) AS v(\"column\", sensitive, leakage)")
def plan_semantics(spark, d):
    names = ["driver_age", "engine_age_days", "genderOfOwner", "stopped_at", "tonnage"]
    s, k = semantics.sensitive_columns(names), semantics.leakage_suspects(names, "stopped")
    return spark.createDataFrame([(c, c in s, c in k) for c in names], "column string, sensitive boolean, leakage boolean")
