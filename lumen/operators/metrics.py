"""Evaluation: classification, ranking, calibration, regression, slices, fairness, selection.

Everything is computed from grouped counts. Rankings go through the distinct
scores, whose running totals are taken in buckets, never in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import double, ratio, skewness
from .quantiles import quantiles

ECE_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]
BUCKETS = 64


def running_totals(df: DataFrame, order: str, values: list[str], buckets: int = BUCKETS) -> DataFrame:
    """`df` with `upto_<v>`: the sum of each value over the rows up to this one by `order` (distinct numbers).

    Rows are bucketed by approximate quantiles; a row's total is that of its
    bucket so far plus the totals of the buckets before, a table of `buckets` rows.
    """
    edges = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < double(order))) if edges else F.lit(0)
    rows = df.withColumn("_b", bucket)
    sums = rows.groupBy("_b").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = Window.partitionBy("_b").orderBy(order)
    out = rows.join(F.broadcast(sums), "_b").withColumns({f"upto_{v}": F.sum(v).over(inside) + F.col(f"_o_{v}") for v in values})
    return out.drop("_b", *[f"_o_{v}" for v in values])


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).cast("string").alias("y"), F.col(p).cast("string").alias("p")).agg(F.count("*").alias("n"))


def classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """accuracy, balanced_accuracy, macro and weighted f1, macro precision and recall, mcc, cohen_kappa: one row, from the confusion counts."""
    cells = confusion(df, y, p)
    labels = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).alias("m"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).alias("t"), F.col("n").alias("m"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    per = labels.groupBy("c").agg(F.sum("t").alias("t"), F.sum("m").alias("m"), F.sum("hit").alias("hit"))
    precision = F.coalesce(ratio(F.col("hit").cast("double"), F.col("m")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("hit").cast("double"), F.col("t")), F.lit(0.0))
    f1 = F.coalesce(ratio(2.0 * F.col("hit"), F.col("t") + F.col("m")), F.lit(0.0))
    s = per.agg(
        F.sum("t").cast("double").alias("n"), F.sum("hit").cast("double").alias("c"), F.sum(F.col("t") * F.col("m")).cast("double").alias("tm"), F.sum(F.col("t") * F.col("t")).cast("double").alias("tt"), F.sum(F.col("m") * F.col("m")).cast("double").alias("mm"),
        F.avg(F.when(F.col("t") > 0, recall)).alias("balanced_accuracy"), F.avg(f1).alias("f1_macro"), F.sum(f1 * F.col("t")).alias("_fw"), F.avg(precision).alias("precision_macro"), F.avg(recall).alias("recall_macro"),
    )
    n, c, tm = F.col("n"), F.col("c"), F.col("tm")
    return s.select(
        (c / n).alias("accuracy"), "balanced_accuracy", "f1_macro", (F.col("_fw") / n).alias("f1_weighted"), "precision_macro", "recall_macro",
        F.coalesce(ratio(c * n - tm, F.sqrt(n * n - F.col("tt")) * F.sqrt(n * n - F.col("mm"))), F.lit(0.0)).alias("mcc"), ratio(c * n - tm, n * n - tm).alias("cohen_kappa"),
    )


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(double(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Rank statistic with ties averaged; null with one class."""
    t = running_totals(_by_score(df, y, score), "s", ["neg"])
    return t.agg(ratio(F.sum(F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2)), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """Sum over the distinct scores, from the top, of the recall step times the precision."""
    t = _by_score(df, y, score).select((-F.col("s")).alias("s"), "pos", (F.col("pos") + F.col("neg")).alias("all"))
    t = running_totals(t, "s", ["pos", "all"])
    return t.agg(ratio(F.sum(F.col("pos") * F.col("upto_pos") / F.col("upto_all")), F.sum("pos").cast("double")).alias("average_precision"))


def one_vs_rest_auc(df: DataFrame, y: str, scores: dict[str, str]) -> DataFrame:
    """Mean over classes of the AUC of each class's score against the rest."""
    parts = [roc_auc(df.withColumn("_is", (F.col(y).cast("string") == label).cast("int")), "_is", score) for label, score in sorted(scores.items())]
    return reduce(lambda a, b: a.union(b), parts).agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def brier_log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), double(p)))
    return df.agg(F.avg(F.pow(double(p) - double(y), F.lit(2.0))).alias("brier"), F.avg(-(double(y) * F.log(q) + (1 - double(y)) * F.log(1 - q))).alias("log_loss"))


def multiclass_log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    """Mean negative log of the probability, in array `p`, of the true class `y` (0, 1, ...); a null or unknown class counts as probability 0."""
    own = F.coalesce(F.get(F.col(p), F.col(y).cast("int")), F.lit(0.0))
    return df.agg(F.avg(-F.log(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), own)))).alias("log_loss"))


def calibration(df: DataFrame, y: str, p: str) -> DataFrame:
    """bin, n, confidence, accuracy over ten bins, closed to the left, the last on both sides."""
    inner = F.array(*[F.lit(e) for e in ECE_EDGES[1:-1]])
    x = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", F.size(F.filter(inner, lambda e: e <= double(p))))
    return x.groupBy("bin").agg(F.count("*").alias("n"), F.avg(double(p)).alias("confidence"), F.avg(double(y)).alias("accuracy"))


def ece(df: DataFrame, y: str, p: str) -> DataFrame:
    c = calibration(df, y, p)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def regression(df: DataFrame, y: str, p: str, n_features: int = 1) -> DataFrame:
    """rmse, mae, r2, adjusted_r2, mape, max_error."""
    a, e = double(y), double(y) - double(p)
    s = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(a) * F.count(a)).alias("sst"), F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(2.220446049250313e-16))).alias("mape"), F.max(F.abs(e)).alias("max_error"))
    r2 = 1 - ratio(F.col("sse"), F.col("sst"))
    return s.select(F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", r2.alias("r2"), (1 - (1 - r2) * (F.col("n") - 1) / F.greatest(F.col("n") - n_features - 1, F.lit(1))).alias("adjusted_r2"), "mape", "max_error")


def residuals(df: DataFrame, y: str, p: str) -> DataFrame:
    e = double(y) - double(p)
    return df.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.max(F.abs(e)).alias("max_abs"), skewness(e).alias("skew"))


def log_loss_of(y: Column, p: Column) -> Column:
    """Loss of a row from the probability of label 1."""
    return -F.log(F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(1e-8)))


def worst(df: DataFrame, loss: Column, key: list[str], k: int = 20) -> DataFrame:
    """The k rows of highest loss, ties by key."""
    return df.withColumn("loss", loss).orderBy(F.desc("loss"), *key).limit(k)


def confused_pairs(df: DataFrame, y: str, p: str, k: int = 10) -> DataFrame:
    return confusion(df, y, p).where("y <> p").orderBy(F.desc("n"), "y", "p").limit(k)


def slices(df: DataFrame, features: list[str], correct: Column, least: int = 5, gap: float = 0.1, distinct: int = 10, most: int | None = 10) -> DataFrame:
    """feature, value, n, accuracy, underperforming: features of few values by value (groups of `least` rows on), others by quartile.

    One grouping-sets aggregation over the features, of which only the first
    `most` are looked at (all, if None): a report is to be read.
    """
    features = features[:most]
    kinds = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in features]).first().asDict()
    numeric = [c for c in features if kinds[c] > distinct and dict(df.dtypes)[c] != "string"]
    edges = quantiles(df, {c: (double(c), [0.0, 0.25, 0.5, 0.75, 1.0]) for c in numeric})

    def label(c: str) -> Column:
        if c not in numeric:
            return F.col(c).cast("string")
        e = sorted(set(edges[c]))
        out = F.when(double(c) <= e[1], F.lit("q1")) if len(e) > 1 else F.when(F.col(c).isNotNull(), F.lit("q1"))
        for i, hi in enumerate(e[2:], 2):
            out = out.when(double(c) <= hi, F.lit(f"q{i}"))
        return out

    used = [c for c in features if kinds[c] <= distinct or c in numeric]
    rows = df.select(*[label(c).alias(f"_f{i}") for i, c in enumerate(used)], correct.cast("double").alias("_ok"))
    names = [f"_f{i}" for i in range(len(used))]
    sets = rows.groupingSets([[F.col(n)] for n in names] + [[]], *[F.col(n) for n in names]).agg(F.count("*").alias("n"), F.avg("_ok").alias("accuracy"), F.grouping_id().alias("_g"))
    k = len(names)
    which = F.coalesce(*[F.when(F.col("_g") == (1 << k) - 1 - (1 << (k - 1 - i)), F.lit(c)) for i, c in enumerate(used)])
    total = sets.where(F.col("_g") == (1 << k) - 1).select(F.col("accuracy").alias("_all"))
    out = sets.where(F.col("_g") != (1 << k) - 1).select(which.alias("feature"), F.coalesce(*names).alias("value"), "n", "accuracy")
    few = [c for c in used if c not in numeric]
    out = out.where(F.col("value").isNotNull() & (~F.col("feature").isin(few) | (F.col("n") >= least)))
    return out.join(F.broadcast(total)).select("feature", "value", "n", "accuracy", (F.col("accuracy") < F.col("_all") - gap).alias("underperforming"))


def fairness(df: DataFrame, group: str, y: str, p: str, least: int = 5) -> DataFrame:
    """value, n, accuracy, positive_rate of each group of `least` rows on, with disparate_impact, accuracy_gap and their flags."""
    g = df.groupBy(F.col(group).cast("string").alias("value")).agg(F.count("*").alias("n"), F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"), F.avg((F.col(p) == 1).cast("double")).alias("positive_rate")).where(F.col("n") >= least)
    whole = g.agg(F.when(F.count("*") >= 2, F.when(F.max("positive_rate") == 0, 1.0).otherwise(F.min("positive_rate") / F.max("positive_rate"))).alias("disparate_impact"), (F.max("accuracy") - F.min("accuracy")).alias("accuracy_gap"))
    return g.join(F.broadcast(whole)).withColumns({"di_flag": ~F.col("disparate_impact").between(0.8, 1.25), "gap_flag": F.col("accuracy_gap") > 0.1})


def fairness_regression(df: DataFrame, group: str, y: str, p: str, least: int = 5) -> DataFrame:
    """value, n, mae, mean_prediction, mae_ratio (greatest over least), flag over 1.5."""
    g = df.groupBy(F.col(group).cast("string").alias("value")).agg(F.count("*").alias("n"), F.avg(F.abs(double(y) - double(p))).alias("mae"), F.avg(double(p)).alias("mean_prediction")).where(F.col("n") >= least)
    whole = g.agg(ratio(F.max("mae"), F.min("mae")).alias("mae_ratio"))
    return g.join(F.broadcast(whole)).withColumn("flag", F.coalesce(F.col("mae_ratio") > 1.5, F.lit(False)))


def majority(df: DataFrame, y: str) -> DataFrame:
    """Baseline: the most frequent class (ties to the smaller) and its accuracy."""
    c = df.where(F.col(y).isNotNull()).groupBy(F.col(y).cast("string").alias("prediction")).agg(F.count("*").alias("n"))
    return c.agg(F.min_by("prediction", F.struct(-F.col("n"), "prediction")).alias("prediction"), (F.max("n") / F.sum("n")).alias("accuracy"))


def mean_baseline(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """`regression` of the test rows when each is predicted the mean of the training rows."""
    mean = train.agg(F.avg(double(y)).alias("_mean"))
    return regression(test.join(F.broadcast(mean)), y, "_mean")


def class_shares(df: DataFrame, y: str) -> DataFrame:
    c = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("n"))
    return c.agg((F.max("n") / F.sum("n")).alias("majority"), (F.min("n") / F.sum("n")).alias("minority"), F.sum("n").alias("n"))


def pareto(df: DataFrame, high: str, low: str) -> DataFrame:
    """`df` with `is_optimal`: no other row has `high` as high and `low` as low and one of them better.

    Skyline by one pass over the best `high` at each distinct `low`: a row is
    dominated if some smaller `low` reaches its `high`, or its own `low` exceeds
    it. Rows with a null are not optimal.
    """
    best = df.where(F.col(high).isNotNull() & F.col(low).isNotNull()).groupBy(double(low).alias("_l")).agg(F.max(double(high)).alias("_h"))
    # a bucket's maximum stands for all smaller ones
    edges = best.agg(F.percentile_approx("_l", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("e")).first()["e"] or []
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < F.col("_l"))) if edges else F.lit(0)
    rows = best.withColumn("_b", bucket)
    tops = rows.groupBy("_b").agg(F.max("_h").alias("_t"))
    tops = tops.select("_b", F.max("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max("_h").over(Window.partitionBy("_b").orderBy("_l").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_in", inside).join(F.broadcast(tops), "_b").select("_l", "_h", F.greatest("_in", "_before").alias("_smaller"))
    out = df.join(rows, double(low) == F.col("_l"), "left")
    ok = (double(high) >= F.col("_h")) & (F.col("_smaller").isNull() | (F.col("_smaller") < double(high)))
    return out.select(*df.columns, F.coalesce(ok, F.lit(False)).alias("is_optimal"))


def bayes_threshold(cost_fp: float, cost_fn: float) -> float:
    """The probability from which acting is cheaper; 0.5 for costs that are not positive numbers."""
    try:
        total = cost_fp + cost_fn
        return cost_fp / total if cost_fp > 0 and cost_fn > 0 and total < float("inf") else 0.5
    except TypeError:
        return 0.5


def decide(df: DataFrame, p: str, cost_fp: float, cost_fn: float) -> DataFrame:
    return df.withColumn("decision", (double(p) >= bayes_threshold(cost_fp, cost_fn)).cast("int"))


def best_model(board: DataFrame, metric: str) -> DataFrame:
    """First row of the leaderboard: lowest score for error metrics, else highest; ties by name."""
    order = F.asc("cv_score") if metric in ("rmse", "mae", "mape") else F.desc("cv_score")
    return board.orderBy(order, "model_name").limit(1)


def fastest(board: DataFrame, tied: list[str]) -> DataFrame:
    return board.where(F.col("model_name").isin(tied)).orderBy("latency_ms", "model_name").limit(1)


def warnings(n: int, minority: float | None, cv: float, test: float, baseline: float | None, metric: str) -> list[str]:
    """Notes on how far a result may be trusted."""
    out = []
    lower = metric in ("rmse", "mae", "mape")
    if n < 500:
        out.append(f"only {n} rows")
    if minority is not None and minority < 0.2:
        out.append(f"the smallest class has {minority:.1%} of the rows")
    gap = (test - cv) / abs(cv) if lower and cv else cv - test
    if gap > 0.15:
        out.append(f"the test score is worse than the cross-validated one by {gap:.2f}")
    if baseline is not None and (test >= baseline if lower else test <= baseline + (0.02 if metric == "roc_auc" else 0)):
        out.append("no better than the baseline")
    return out
