"""Evaluation queries. Scores and predictions are made from the tables' own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import significance as S
from .features import LINE, LINE_SQL
from .profile import rounded
from .registry import query, table

_SCORED = "l_returnflag, l_linestatus, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 5 + l_tax * 2 AS p, round(l_discount * 10, 1) AS s"


def scored(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "l_discount * 5 + l_tax * 2 AS p", "round(l_discount * 10, 1) AS s")


@query("eval_confusion", "SELECT CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS p, count(*) AS n FROM labels GROUP BY 1, 2")
def eval_confusion(spark, d):
    return M.confusion(table(spark, d, "labels"), "quality", "toxic")


_CLASSES = "SELECT CAST(l_linenumber % 3 AS VARCHAR) AS y, CAST(CASE WHEN l_partkey % 4 = 0 THEN (l_linenumber + 1) % 3 ELSE l_linenumber % 3 END AS VARCHAR) AS p FROM lineitem"


@query(
    "eval_classification",
    f"""WITH t AS ({_CLASSES}), c AS (SELECT DISTINCT y AS c FROM t UNION SELECT DISTINCT p FROM t),
    k AS (SELECT c, CAST((SELECT count(*) FROM t WHERE y = c) AS DOUBLE) AS t, CAST((SELECT count(*) FROM t WHERE p = c) AS DOUBLE) AS m, CAST((SELECT count(*) FROM t WHERE y = c AND p = c) AS DOUBLE) AS h FROM c),
    s AS (SELECT sum(t) AS n, sum(h) AS c, sum(t * m) AS tm, sum(t * t) AS tt, sum(m * m) AS mm, avg(h / t) AS r, avg(2 * h / (t + m)) AS f, sum(2 * h / (t + m) * t) AS fw, avg(h / m) AS p FROM k)
    SELECT round(c / n, 6) AS accuracy, round(r, 6) AS balanced_accuracy, round(f, 6) AS f1_macro, round(fw / n, 6) AS f1_weighted, round(p, 6) AS precision_macro, round(r, 6) AS recall_macro,
    round((c * n - tm) / (sqrt(n * n - tt) * sqrt(n * n - mm)), 6) AS mcc, round((c * n - tm) / (n * n - tm), 6) AS cohen_kappa FROM s""",
)
def eval_classification(spark, d):
    df = table(spark, d, "lineitem").selectExpr("cast(l_linenumber % 3 as string) AS y", "cast(CASE WHEN l_partkey % 4 = 0 THEN (l_linenumber + 1) % 3 ELSE l_linenumber % 3 END as string) AS p")
    return rounded(M.classification(df, "y", "p"))


@query("eval_roc_auc", f"WITH t AS (SELECT {_SCORED} FROM lineitem), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS r FROM t) SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2e0) / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0)), 6) AS roc_auc FROM r")
def eval_roc_auc(spark, d):
    return rounded(M.roc_auc(scored(spark, d), "y", "s"))


@query("eval_roc_auc_continuous", f"WITH t AS (SELECT {_SCORED} FROM lineitem), r AS (SELECT y, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2e0 AS r FROM t) SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2e0) / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0)), 6) AS roc_auc FROM r")
def eval_roc_auc_continuous(spark, d):
    """Many distinct scores, which the buckets are for."""
    return rounded(M.roc_auc(scored(spark, d), "y", "l_extendedprice"))


@query("eval_average_precision", f"WITH t AS (SELECT {_SCORED} FROM lineitem), g AS (SELECT s, CAST(sum(y) AS DOUBLE) AS pos, count(*) AS n FROM t GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM g) SELECT round(sum(pos * cp / cn) / sum(pos), 6) AS average_precision FROM c")
def eval_average_precision(spark, d):
    return rounded(M.average_precision(scored(spark, d), "y", "s"))


_OVR = "(SELECT CAST(l_linenumber % 3 AS VARCHAR) AS y, CASE WHEN l_linenumber % 3 = 0 THEN l_discount ELSE l_tax END AS a, l_tax + l_discount AS b, l_quantity AS c FROM lineitem)"


@query("eval_multiclass_auc", "SELECT round(avg(auc), 6) AS roc_auc_ovr FROM (" + " UNION ALL ".join(f"SELECT (sum(r) FILTER (WHERE y = '{k}') - count(*) FILTER (WHERE y = '{k}') * (count(*) FILTER (WHERE y = '{k}') + 1) / 2e0) / (CAST(count(*) FILTER (WHERE y = '{k}') AS DOUBLE) * count(*) FILTER (WHERE y <> '{k}')) AS auc FROM (SELECT y, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2e0 AS r FROM {_OVR})" for k, s in (("0", "a"), ("1", "b"), ("2", "c"))) + ")")
def eval_multiclass_auc(spark, d):
    df = table(spark, d, "lineitem").selectExpr("cast(l_linenumber % 3 as string) AS y", "CASE WHEN l_linenumber % 3 = 0 THEN l_discount ELSE l_tax END AS a", "l_tax + l_discount AS b", "l_quantity AS c")
    return rounded(M.one_vs_rest_auc(df, "y", {"0": "a", "1": "b", "2": "c"}))


@query("eval_brier_logloss", f"WITH t AS (SELECT {_SCORED} FROM lineitem), q AS (SELECT y, p, greatest(1e-15, least(1 - 1e-15, p)) AS q FROM t) SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM q")
def eval_brier_logloss(spark, d):
    return rounded(M.brier_log_loss(scored(spark, d), "y", "p"))


_EDGES = ", ".join(repr(e) + ("e0" if "e" not in repr(e) else "") for e in M.ECE_EDGES[1:-1])


@query("eval_ece", f"WITH t AS (SELECT {_SCORED} FROM lineitem), b AS (SELECT len(list_filter([{_EDGES}], lambda e: e <= p)) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM t GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def eval_ece(spark, d):
    return rounded(M.ece(scored(spark, d), "y", "p"))


@query("eval_calibration", f"WITH t AS (SELECT {_SCORED} FROM lineitem) SELECT CAST(len(list_filter([{_EDGES}], lambda e: e <= p)) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM t GROUP BY 1")
def eval_calibration(spark, d):
    return rounded(M.calibration(scored(spark, d), "y", "p"))


_REG = "(SELECT o_orderkey, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS p FROM orders)"


def fitted(spark, d):
    df = table(spark, d, "orders")
    mean = df.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("p"))
    return df.join(F.broadcast(mean), "o_orderpriority").selectExpr("o_orderkey", "o_totalprice AS y", "p")


@query("eval_regression", f"WITH s AS (SELECT count(*) AS n, sum((y - p) * (y - p)) AS sse, avg(abs(y - p)) AS mae, var_pop(y) * count(*) AS sst, avg(abs(y - p) / abs(y)) AS mape, max(abs(y - p)) AS mx FROM {_REG}) SELECT round(sqrt(sse / n), 4) AS rmse, round(mae, 4) AS mae, round(1 - sse / sst, 6) AS r2, round(1 - (sse / sst) * (n - 1) / (n - 2), 6) AS adjusted_r2, round(mape, 6) AS mape, round(mx, 4) AS max_error FROM s")
def eval_regression(spark, d):
    return rounded(M.regression(fitted(spark, d), "y", "p"), rmse=4, mae=4, max_error=4)


@query("eval_residuals", f"SELECT round(stddev_pop(y - p), 4) AS std, round(max(abs(y - p)), 4) AS max_abs, round(skewness(y - p), 6) AS skew FROM {_REG}")
def eval_residuals(spark, d):
    return rounded(M.residuals(fitted(spark, d), "y", "p").select("std", "max_abs", "skew"), std=4, max_abs=4)


_OK = "((p >= 0.4e0) = (y = 1))"


@query("eval_slices", f"WITH t AS (SELECT {_SCORED} FROM lineitem), o AS (SELECT avg(CAST({_OK} AS DOUBLE)) AS a FROM t), q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM t) SELECT feature, value, n, round(accuracy, 6) AS accuracy, accuracy < a - 0.1e0 AS underperforming FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n, avg(CAST({_OK} AS DOUBLE)) AS accuracy FROM t GROUP BY 2 HAVING count(*) >= 5" for c in ("l_returnflag", "l_linestatus", "l_linenumber")) + f" UNION ALL SELECT 'l_quantity', CASE WHEN l_quantity <= q[1] THEN 'q1' WHEN l_quantity <= q[2] THEN 'q2' WHEN l_quantity <= q[3] THEN 'q3' ELSE 'q4' END, count(*), avg(CAST({_OK} AS DOUBLE)) FROM t, q GROUP BY 2), o")
def eval_slices(spark, d):
    df = scored(spark, d)
    return rounded(M.slices(df, ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"], (F.col("p") >= 0.4) == (F.col("y") == 1)))


@query("eval_worst", f"WITH t AS (SELECT {LINE_SQL}, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 5 + l_tax * 2 AS p FROM lineitem) SELECT *, round(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-8)), 6) AS loss FROM t ORDER BY round(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-8)), 6) DESC, {LINE_SQL} LIMIT 20")
def eval_worst(spark, d):
    return M.worst(scored(spark, d), F.round(M.log_loss_of(F.col("y"), F.col("p")), 6), LINE).select(*LINE, "y", "p", "loss")


@query("eval_confused_pairs", "SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END AS p, count(*) AS n FROM orders GROUP BY 1, 2 HAVING y <> p ORDER BY 3 DESC, 1, 2 LIMIT 10")
def eval_confused_pairs(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderstatus AS y", "CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END AS p")
    return M.confused_pairs(df, "y", "p")


_FAIR = "(SELECT c_mktsegment AS g, CAST(c_acctbal > 5000 AS INTEGER) AS y, CAST(c_acctbal > CASE WHEN c_mktsegment = 'BUILDING' THEN 7500 ELSE 4500 END AS INTEGER) AS p FROM customer)"


@query("eval_fairness", f"WITH g AS (SELECT g AS value, count(*) AS n, avg(CAST(y = p AS DOUBLE)) AS a, avg(CAST(p = 1 AS DOUBLE)) AS r FROM {_FAIR} GROUP BY 1 HAVING count(*) >= 5), w AS (SELECT CASE WHEN max(r) = 0 THEN 1 ELSE min(r) / max(r) END AS di, max(a) - min(a) AS gap FROM g) SELECT value, n, round(a, 6) AS accuracy, round(r, 6) AS positive_rate, round(di, 6) AS disparate_impact, round(gap, 6) AS accuracy_gap, di NOT BETWEEN 0.8 AND 1.25 AS di_flag, gap > 0.1 AS gap_flag FROM g, w")
def eval_fairness(spark, d):
    df = table(spark, d, "customer").selectExpr("c_mktsegment AS g", "cast(c_acctbal > 5000 as int) AS y", "cast(c_acctbal > CASE WHEN c_mktsegment = 'BUILDING' THEN 7500 ELSE 4500 END as int) AS p")
    return rounded(M.fairness(df, "g", "y", "p"))


@query("eval_fairness_regression", f"WITH g AS (SELECT o_orderstatus AS value, count(*) AS n, avg(abs(y - p)) AS mae, avg(p) AS mp FROM (SELECT o_orderstatus, o_totalprice AS y, avg(o_totalprice) OVER () * CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS p FROM orders) GROUP BY 1 HAVING count(*) >= 5), w AS (SELECT max(mae) / min(mae) AS r FROM g) SELECT value, n, round(mae, 4) AS mae, round(mp, 4) AS mean_prediction, round(r, 6) AS mae_ratio, r > 1.5 AS flag FROM g, w")
def eval_fairness_regression(spark, d):
    df = table(spark, d, "orders")
    df = df.join(F.broadcast(df.agg(F.avg("o_totalprice").alias("m")))).selectExpr("o_orderstatus", "o_totalprice AS y", "m * CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS p")
    return rounded(M.fairness_regression(df, "o_orderstatus", "y", "p"), mae=4, mean_prediction=4)


@query("eval_baseline", "WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1) SELECT (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS prediction, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS accuracy FROM c")
def eval_baseline(spark, d):
    return rounded(M.majority(table(spark, d, "orders"), "o_orderpriority"))


@query("eval_class_shares", "WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) SELECT round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS majority, round(min(n) / CAST(sum(n) AS DOUBLE), 6) AS minority, CAST(sum(n) AS BIGINT) AS n FROM c")
def eval_class_shares(spark, d):
    return rounded(M.class_shares(table(spark, d, "orders"), "o_orderpriority"))


@query("sel_pareto", "WITH b AS (SELECT p_brand, max(p_retailprice) AS score, avg(p_size) AS cost FROM part GROUP BY 1) SELECT p_brand, round(score, 6) AS score, round(cost, 6) AS cost, NOT EXISTS (SELECT 1 FROM b q WHERE q.score >= b.score AND q.cost <= b.cost AND (q.score > b.score OR q.cost < b.cost)) AS is_optimal FROM b")
def sel_pareto(spark, d):
    df = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("score"), F.avg("p_size").alias("cost"))
    return rounded(M.pareto(df, "score", "cost"))


@query("sel_pareto_rows", "SELECT p_partkey, NOT EXISTS (SELECT 1 FROM part q WHERE q.p_retailprice >= part.p_retailprice AND q.p_size <= part.p_size AND (q.p_retailprice > part.p_retailprice OR q.p_size < part.p_size)) AS is_optimal FROM part")
def sel_pareto_rows(spark, d):
    """Every part, not just the brands."""
    return M.pareto(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size").select("p_partkey", "is_optimal")


@query("sel_best_model", "SELECT p_brand AS model_name, round(avg(p_retailprice), 4) AS cv_score FROM part GROUP BY 1 ORDER BY avg(p_retailprice), 1 LIMIT 1")
def sel_best_model(spark, d):
    """Error metrics rank from the lowest."""
    df = table(spark, d, "part").groupBy(F.col("p_brand").alias("model_name")).agg(F.avg("p_retailprice").alias("cv_score"))
    return rounded(M.best_model(df, "rmse"), 4)


@query("sig_mcnemar", "WITH t AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_discount > 0.05e0 AS INTEGER) AS a, CAST(l_tax > 0.04e0 AS INTEGER) AS b FROM lineitem), s AS (SELECT count(*) FILTER (WHERE a = y AND b <> y) AS b, count(*) FILTER (WHERE a <> y AND b = y) AS c FROM t) SELECT b, c, round(CASE WHEN b + c < 25 THEN least(b, c) ELSE (abs(b - c) - 1) * (abs(b - c) - 1) / CAST(b + c AS DOUBLE) END, 6) AS statistic, b + c < 25 AS exact FROM s")
def sig_mcnemar(spark, d):
    df = table(spark, d, "lineitem").selectExpr("cast(l_returnflag = 'R' as int) AS y", "cast(l_discount > 0.05D as int) AS a", "cast(l_tax > 0.04D as int) AS b")
    return rounded(S.mcnemar(df, "y", "a", "b"))


_PS = [("a", 0.001), ("b", 0.008), ("c", 0.039), ("d", 0.041), ("e", 0.042), ("f", 0.01)]


@query("sig_holm", f"WITH t(name, p) AS (VALUES {', '.join(f"('{n}', {p}e0)" for n, p in _PS)}), r AS (SELECT name, p, p <= 0.05e0 / (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) AS ok FROM t) SELECT name, p, coalesce(bool_and(ok) OVER (ORDER BY p, name), false) AS reject FROM r")
def sig_holm(spark, d):
    return S.holm(spark.createDataFrame(_PS, "name string, p double"), "p", "name")


@query("sig_bootstrap")
def sig_bootstrap(spark, d):
    """Accuracy of three rules and its interval, by a distributed bootstrap."""
    df = table(spark, d, "lineitem").selectExpr("cast(l_returnflag = 'R' as int) AS y", "cast(l_discount > 0.05D as int) AS by_discount", "cast(l_tax > 0.04D as int) AS by_tax", "0 AS never")
    return S.bootstrap_counts(df, "y", ["by_discount", "by_tax", "never"], 200)


@query("eval_custom_metric", "SELECT l_returnflag AS g, round(sqrt(avg((l_tax - l_discount) * (l_tax - l_discount))), 6) AS value FROM lineitem GROUP BY 1")
def eval_custom_metric(spark, d):
    return rounded(S.metric_by_group(table(spark, d, "lineitem"), "l_returnflag", "l_tax", "l_discount", lambda y, p: F.sqrt(F.avg((y - p) * (y - p)))))


@query("thr_bayes", f"SELECT {LINE_SQL}, CAST(l_discount * 5 + l_tax * 2 >= 1e0 / 4 AS INTEGER) AS decision FROM lineitem")
def thr_bayes(spark, d):
    return M.decide(scored(spark, d), "p", 1.0, 3.0).select(*LINE, "decision")
