"""Model queries. What is fitted iteratively has no SQL form; closed-form fits are checked."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..functions import persist
from ..operators import boosting as B
from ..operators import explain as X
from ..operators import extratrees as E
from ..operators import trees
from ..operators import run as R
from ..operators import training as T
from ..operators.features import FeatureTransformer
from ..operators.prep import hash_fold
from .profile import rounded
from .registry import query, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rows(spark, d, label="cast(l_returnflag = 'R' as int)"):
    df = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity / 50 AS l_quantity", "l_extendedprice / 100000 AS l_extendedprice", "l_discount * 10 AS l_discount", "l_tax * 10 AS l_tax", f"{label} AS y")
    return hash_fold(T.assemble(df, FEATURES, "y"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], 3)


@query("train_least_squares", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def train_least_squares(spark, d):
    df = T.assemble(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    m = T.REGISTRY["ridge"].build("regression", {"alpha": 0.0}, T.facts(df, ["l_quantity"])).fit(df)
    return rounded(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double"), 4)


@query(
    "model_bundle",
    """WITH r AS (SELECT *, l_quantity * l_discount AS x FROM lineitem), f AS (SELECT regr_slope(l_extendedprice, x) AS a, regr_intercept(l_extendedprice, x) AS b FROM r WHERE l_orderkey % 5 <> 0)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a * x + b, 1) AS prediction FROM r, f WHERE l_orderkey % 5 = 0""",
)
def model_bundle(spark, d):
    """Features, assembler and model fitted, saved, loaded from disk and replayed on rows that were not trained on."""
    df = table(spark, d, "lineitem")
    train = df.where("l_orderkey % 5 <> 0")
    specs = FeatureTransformer([{"op": "product", "params": {"a": "l_quantity", "b": "l_discount"}}]).fit(train)
    made = T.assemble(specs.transform(train), specs.output_columns, "l_extendedprice")
    line = T.REGISTRY["ridge"].build("regression", {"alpha": 0.0}, T.facts(made, specs.output_columns)).fit(made)
    path = persist.new_folder(spark, "bundle")
    persist.Bundle([specs, VectorAssembler(inputCols=specs.output_columns, outputCol="features", handleInvalid="keep"), line], specs.required_columns).save(path)
    out = persist.load(spark, path).transform(df.where("l_orderkey % 5 = 0"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("prediction", 1).alias("prediction"))


@query("train_leaderboard")
def train_leaderboard(spark, d):
    """Two families searched by cross-validation, and the Pareto set of score and latency."""
    df = _rows(spark, d, "cast(l_extendedprice * l_discount > 1500 as int)").select("features", "label", "fold").cache()
    results = [T.search(df, FEATURES, m, "binary", "roc_auc") for m in ("logistic_regression", "decision_tree")]
    return T.leaderboard(spark, results, "roc_auc")


@query(
    "train_run",
    """WITH r AS (SELECT l_orderkey % 5 = 0 AS t, (l_extendedprice * l_discount > 1500)::INT AS big FROM lineitem),
    m AS (SELECT (sum(big) * 2 > count(*))::INT AS most FROM r WHERE NOT t),
    f AS (SELECT count(*) AS n, 2.0 * sum(big * most) / nullif(sum(big) + sum(most), 0) AS f1, 2.0 * sum(big * big) / (sum(big) + sum(big)) AS rule FROM r, m WHERE t)
    SELECT (SELECT count(*) FROM r WHERE NOT t) AS n_train, n AS n_test, round(coalesce(f1, 0), 9) AS baseline, coalesce(f1, 0) < rule AS beaten FROM f""",
)
def train_run(spark, d):
    """A whole run over raw rows: the sizes, the baseline's F1, and whether the chosen model's replayed predictions beat it on the held-out rows.

    The label is a rule over two columns, which the SQL applies and the models must find.
    """
    df = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate", "CASE WHEN l_extendedprice * l_discount > 1500 THEN 'big' ELSE 'a small one' END AS size")
    key, price = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], [{"op": "product", "params": {"a": "l_extendedprice", "b": "l_discount"}}]
    got = R.run(df, "size", key, ["logistic_regression", "decision_tree"], price, metric="f1", is_test=F.expr("l_orderkey % 5 = 0"))
    scored = got.model.transform(df.where("l_orderkey % 5 = 0").withColumn("l_linenumber", F.struct("l_linenumber", "size"))).select(F.col("l_linenumber.size").alias("y"), "predicted_label")
    r = scored.agg(F.count_if(F.expr("y = 'big' AND predicted_label = 'big'")).alias("tp"), F.count_if(F.expr("y = 'big'")).alias("p"), F.count_if(F.expr("predicted_label = 'big'")).alias("said")).first()
    made = spark.createDataFrame([(got.rows["train"], got.rows["test"], float(got.baseline), 2 * r["tp"] / max(1, r["p"] + r["said"]) > got.baseline)], "n_train long, n_test long, baseline double, beaten boolean")
    return made.withColumn("baseline", F.round("baseline", 9))


@query(
    "train_boosted_split",
    """WITH m AS (SELECT avg(l_extendedprice) AS mu FROM lineitem),
    r AS (SELECT unnest([{'i': 0, 'f': 'l_quantity', 'x': l_quantity::DOUBLE}, {'i': 1, 'f': 'l_discount', 'x': l_discount::DOUBLE}, {'i': 2, 'f': 'l_tax', 'x': l_tax::DOUBLE}], recursive := true), mu - l_extendedprice AS g FROM lineitem, m),
    c AS (SELECT i, f, x, sum(g) AS g, count(*) AS n FROM r GROUP BY i, f, x),
    w AS (SELECT i, f, x, sum(g) OVER (PARTITION BY i ORDER BY x) AS gl, sum(n) OVER (PARTITION BY i ORDER BY x) AS nl, sum(g) OVER (PARTITION BY i) AS ga, sum(n) OVER (PARTITION BY i) AS na FROM c)
    SELECT f AS feature, x AS threshold, CAST(nl AS BIGINT) AS n_left, CAST(na - nl AS BIGINT) AS n_right, round(-gl / (nl + 1), 3) AS left_weight, round(-(ga - gl) / (na - nl + 1), 3) AS right_weight
    FROM w WHERE na > nl ORDER BY gl * gl / (nl + 1) + (ga - gl) * (ga - gl) / (na - nl + 1) DESC, i, x LIMIT 1""",
)
def train_boosted_split(spark, d):
    """The first split of Newton boosting of a number, and its leaves' weights."""
    columns = ["l_quantity", "l_discount", "l_tax"]
    model = B.NewtonBoosting("regression", B.Growth(rounds=1, rate=1.0, depth=1)).fit(T.assemble(table(spark, d, "lineitem"), columns, "l_extendedprice"))
    t = model.ensemble().trees[0]
    a, b = int(t.left[0]), int(t.right[0])
    made = [(columns[int(t.feature[0])], float(t.threshold[0]), int(t.cover[a]), int(t.cover[b]), float(t.value[a]), float(t.value[b]))]
    return rounded(spark.createDataFrame(made, "feature string, threshold double, n_left long, n_right long, left_weight double, right_weight double"), 3)


_CUT = ["l_quantity", "l_discount", "l_tax"]
_TRIED, _SHARES = (a.tolist() for a in E.drawn(42, 0, 1, len(_CUT)))


@query(
    "train_random_split",
    f"""WITH r AS (SELECT l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, (l_extendedprice * l_discount > 1500)::INT AS y FROM lineitem),
    t AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{_CUT[f]}' AS f, min({_CUT[f]}) + {_SHARES[f]!r}::DOUBLE * (max({_CUT[f]}) - min({_CUT[f]})) AS x FROM r" for i, f in enumerate(_TRIED))}),
    s AS ({" UNION ALL ".join(f"SELECT t.i, t.f, t.x, r.{c} <= t.x AS low, y FROM r, t WHERE t.f = '{c}'" for c in _CUT)}),
    c AS (SELECT i, f, x, (count(*) FILTER (WHERE low))::DOUBLE AS a, (sum(y) FILTER (WHERE low))::DOUBLE AS p, (count(*) FILTER (WHERE NOT low))::DOUBLE AS b, (sum(y) FILTER (WHERE NOT low))::DOUBLE AS q FROM s GROUP BY i, f, x)
    SELECT f AS feature, round(x, 9) AS threshold, a::BIGINT AS n_left, b::BIGINT AS n_right, round(p / a, 9) AS left_value, round(q / b, 9) AS right_value FROM c ORDER BY round((p * p + (a - p) * (a - p)) / a + (q * q + (b - q) * (b - q)) / b, 6) DESC, i LIMIT 1""",
)
def train_random_split(spark, d):
    """The first split of an extremely randomised tree that tries all features, and its leaves' shares; the SQL cuts at the same shares of the ranges."""
    df = T.assemble(table(spark, d, "lineitem").withColumn("y", F.expr("cast(l_extendedprice * l_discount > 1500 as int)")), _CUT, "y")
    made = E.RandomCuts("binary", E.Forest(trees=1, depth=1, tried=1.0)).fit(df).ensemble().trees[0]
    a, b = int(made.left[0]), int(made.right[0])
    row = (_CUT[int(made.feature[0])], float(made.threshold[0]), int(made.cover[a]), int(made.cover[b]), float(made.value[a]), float(made.value[b]))
    return rounded(spark.createDataFrame([row], "feature string, threshold double, n_left long, n_right long, left_value double, right_value double"), 9)


@query(
    "train_neighbours",
    """WITH d AS (SELECT s_suppkey, abs(round(s_acctbal * 100) - round(c_acctbal * 100)) AS d FROM supplier, customer), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d) AS r FROM d)
    SELECT s_suppkey, round(sum(d)::DOUBLE, 2) AS distance, CAST(5 AS BIGINT) AS n FROM r WHERE r <= 5 GROUP BY s_suppkey""",
)
def train_neighbours(spark, d):
    """Each supplier's distance to the five customers of nearest balance."""
    cents = lambda t, c: table(spark, d, t).withColumn("v", F.round(F.col(c) * 100))
    model = T.REGISTRY["knn"].build("regression", {"k": 5}, {}).fit(T.assemble(cents("customer", "c_acctbal"), ["v"], "v"))
    asked = cents("supplier", "s_acctbal").select(F.col("s_suppkey").cast("long").alias("q"), F.array((F.col("v") - model.center[0]) / model.scale[0]).alias("x"))
    found, _ = model.neighbours(asked)
    return found.groupBy(F.col("q").alias("s_suppkey")).agg(F.round(F.sum(F.col("distance") * F.col("n")) * model.scale[0], 2).alias("distance"), F.sum("n").alias("n"))


@query(
    "explain_tree",
    """WITH r AS (SELECT l_quantity <= 25 AS q, l_discount <= 0.05 AS s, l_extendedprice AS y FROM lineitem),
    t AS (SELECT count(*) AS n, avg(y) AS e, count(*) FILTER (WHERE q) AS nq, avg(y) FILTER (WHERE q) AS mq, avg(y) FILTER (WHERE q AND s) AS m1, avg(y) FILTER (WHERE q AND NOT s) AS m2, avg(y) FILTER (WHERE NOT q) AS m3 FROM r),
    v AS (SELECT e AS none, CASE WHEN q THEN mq ELSE m3 END AS vq, (nq * CASE WHEN s THEN m1 ELSE m2 END + (n - nq) * m3) / n AS vs, CASE WHEN NOT q THEN m3 WHEN s THEN m1 ELSE m2 END AS vqs FROM r, t)
    SELECT 'l_quantity' AS feature, round(avg(abs(((vq - none) + (vqs - vs)) / 2)), 4) AS importance FROM v UNION ALL SELECT 'l_discount', round(avg(abs(((vs - none) + (vqs - vq)) / 2)), 4) FROM v""",
)
def explain_tree(spark, d):
    """Mean absolute attributions of a tree with given splits, its leaves and covers taken from the table."""
    df = table(spark, d, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias("features"), F.col("l_extendedprice").alias("y"))
    q, s = F.col("features")[0] <= 25, F.col("features")[1] <= 0.05
    at = F.when(~q, 2).when(s, 3).otherwise(4)
    leaves = {r["node"]: r for r in df.groupBy(at.alias("node")).agg(F.avg("y").alias("v"), F.count("*").alias("n")).collect()}
    value, n = (lambda i: leaves[i]["v"]), (lambda i: leaves[i]["n"])
    tree = trees.Tree(np.array([0, 1, -1, -1, -1]), np.array([25.0, 0.05, 0, 0, 0]), np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]), np.array([0, 0, value(2), value(3), value(4)]), np.array([n(2) + n(3) + n(4), n(3) + n(4), n(2), n(3), n(4)], float))
    return rounded(trees.importance(df, trees.Ensemble([tree], [0.0]), ["l_quantity", "l_discount"]), 4)


@query("train_voting")
def train_voting(spark, d):
    df = _rows(spark, d, "cast(l_extendedprice * l_discount > 1500 as int)")
    f = T.facts(df, FEATURES)
    members = [T.REGISTRY[m].build("binary", {}, f).fit(df) for m in ("logistic_regression", "naive_bayes")]
    out = T.VotingModel(members, "binary").transform(df)
    return out.groupBy("y", "prediction").agg(F.count("*").alias("n"))


@query("explain_linear_shapley", "SELECT 'l_quantity' AS feature, round(avg(abs(2 * (l_quantity - m))), 6) AS importance FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem) UNION ALL SELECT 'l_tax', round(avg(abs(-3 * (l_tax - m))), 6) FROM lineitem, (SELECT avg(l_tax) AS m FROM lineitem)")
def explain_linear_shapley(spark, d):
    return rounded(X.linear_shapley(table(spark, d, "lineitem"), [2.0, -3.0], ["l_quantity", "l_tax"]))


@query("explain_partial_dependence")
def explain_partial_dependence(spark, d):
    df = _rows(spark, d, "cast(l_extendedprice * l_discount > 1500 as int)")
    model = T.REGISTRY["decision_tree"].build("binary", {}, T.facts(df, FEATURES)).fit(df)
    return X.partial_dependence(df.drop("features"), model, FEATURES, "l_discount", 5)


@query(
    "explain_dependence_plane",
    """WITH r AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b FROM lineitem),
    s AS (SELECT avg(y) AS my, avg(a) AS ma, (covar_pop(y, a) * var_pop(b) - covar_pop(y, b) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ^ 2) AS slope, quantile_cont(a, 0.05) AS lo, quantile_cont(a, 0.95) AS hi FROM r)
    SELECT lo + i * (hi - lo) / 4 AS value, round(my + slope * (lo + i * (hi - lo) / 4 - ma), 3) AS mean FROM s, range(5) g(i)""",
)
def explain_dependence_plane(spark, d):
    """How a least-squares plane depends on one of its two columns, the other as in the table."""
    df = T.assemble(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    plane = T.REGISTRY["ridge"].build("regression", {"alpha": 0.0}, T.facts(df, ["l_quantity", "l_discount"])).fit(df)
    out = X.partial_dependence(df.withColumn("l_quantity", F.col("l_quantity").cast("double")), plane, ["l_quantity", "l_discount"], "l_quantity", 5, regression=True)
    return out.withColumn("mean", F.round("mean", 3))


@query("explain_permutation")
def explain_permutation(spark, d):
    df = _rows(spark, d, "cast(l_extendedprice * l_discount > 1500 as int)")
    model = T.REGISTRY["decision_tree"].build("binary", {}, T.facts(df, FEATURES)).fit(df)
    return X.permutation_importance(df, model, FEATURES, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "accuracy", 1)
