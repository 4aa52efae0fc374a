"""Explanations: permutation importance, partial dependence, Shapley values, local surrogates, recursive elimination."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Model
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.persist import frozen
from .quantiles import quantiles
from .training import LOWER_IS_BETTER, evaluate, positive

#: Rows that explanations look at, by hash of the row's key; rows of a bucket within which values are dealt anew.
ROWS, BUCKET_ROWS = 200, 100_000


def sample(df: DataFrame, key: list[str], n: int = ROWS, seed: int = 42) -> DataFrame:
    """The n rows with the smallest hash of their key: the same ones every time."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def _features(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df.drop("features"))


def permutation_importance(df: DataFrame, model: Model, columns: list[str], key: list[str], metric: str, repeats: int = 3, seed: int = 42) -> DataFrame:
    """feature, importance, std: loss of the metric when a column's values are dealt anew.

    Values travel by rank of two hashes within buckets of rows, so a column's
    distribution stays; the number of buckets follows the rows. A repeat is one
    join, which brings every row another row's values of all columns.
    """
    from pyspark.sql.window import Window

    base = evaluate(model.transform(_features(df, columns)), metric)
    sign = -1 if metric in LOWER_IS_BETTER else 1
    buckets = max(1, df.count() // BUCKET_ROWS)
    drops: dict[str, list[float]] = {c: [] for c in columns}
    for r in range(repeats):
        part = F.pmod(F.xxhash64(F.lit(seed + r), *key), F.lit(buckets))
        place = lambda salt: F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(salt), *key), *key))
        ranked = df.withColumn("_b", part)
        other = ranked.withColumn("_i", place(2 * r + 2)).select("_b", "_i", *[F.col(c).alias(f"_other{i}") for i, c in enumerate(columns)])
        dealt = frozen(ranked.withColumn("_i", place(2 * r + 1)).join(other, ["_b", "_i"]).drop("_b", "_i"))
        for i, c in enumerate(columns):
            shuffled = dealt.withColumn(c, F.col(f"_other{i}"))
            drops[c].append(sign * (base - evaluate(model.transform(_features(shuffled, columns)), metric)))
    rows = [(c, float(np.mean(d)), float(np.std(d))) for c, d in drops.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, std double").orderBy(F.desc("importance"), "feature")


def partial_dependence(df: DataFrame, model: Model, columns: list[str], feature: str, points: int = 10, regression: bool = False) -> DataFrame:
    """value, mean: the mean output with one column set to each point of a grid between its 5th and 95th percentile. A row becomes `points` rows."""
    lo, hi = quantiles(df, {feature: (F.col(feature).cast("double"), [0.05, 0.95])})[feature]
    grid = [float(v) for v in np.linspace(lo, hi, points)]
    rows = df.withColumn("_g", F.explode(F.array(*[F.lit(v) for v in grid]))).withColumn(feature, F.col("_g"))
    scored = model.transform(_features(rows, columns))
    out = F.col("prediction") if regression else positive(scored)
    return scored.groupBy(F.col("_g").alias("value")).agg(F.avg(out).alias("mean"))


def linear_shapley(df: DataFrame, coefficients: list[float], columns: list[str]) -> DataFrame:
    """feature, importance: mean absolute Shapley value of each column of a linear model, w (x - mean x)."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.agg(*[F.avg(F.abs(F.lit(float(w)) * (F.col(c) - F.lit(means[c])))).alias(c) for c, w in zip(columns, coefficients, strict=True)]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("importance")) for c in columns]))
    )


def sampled_shapley(df: DataFrame, model: Model, columns: list[str], key: list[str], permutations: int = 4, seed: int = 42, regression: bool = False) -> DataFrame:
    """feature, importance: mean absolute Shapley value over the sampled rows, by random orders against the column means. All coalitions of a row are scored in one batch."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    rng = np.random.default_rng(seed)
    steps = []
    for p in range(permutations):
        order = list(rng.permutation(len(columns)))
        for i in range(len(order) + 1):
            steps.append((p, i, [columns[j] for j in order[:i]], columns[order[i - 1]] if i else None))
    plans = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i"), F.array(*[F.lit(c) for c in on]).cast("array<string>").alias("on"), F.lit(f).cast("string").alias("f")) for p, i, on, f in steps])
    rows = sample(df, key).select(*key, *[c for c in columns if c not in key]).withColumn("_x", F.explode(plans)).select("*", "_x.*")
    rows = rows.withColumns({c: F.when(F.array_contains("on", c), F.col(c).cast("double")).otherwise(F.lit(float(means[c]))) for c in columns if c not in key})
    scored = model.transform(_features(rows, columns))
    from pyspark.sql.window import Window

    out = (F.col("prediction") if regression else positive(scored)).alias("_o")
    gain = scored.select(*key, "p", "i", "f", out).withColumn("_d", F.col("_o") - F.lag("_o").over(Window.partitionBy(*key, "p").orderBy("i")))
    per_row = gain.where("f is not null").groupBy(*key, "f").agg(F.avg("_d").alias("phi"))
    return per_row.groupBy(F.col("f").alias("feature")).agg(F.avg(F.abs("phi")).alias("importance"))


def local_surrogate(df: DataFrame, model: Model, columns: list[str], row: dict, n: int = 500, seed: int = 42, k: int = 10, regression: bool = False) -> DataFrame:
    """feature, weight: a weighted linear fit to the model around one row; the k largest weights."""
    spark = df.sparkSession
    scale = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    noise = spark.range(n).select(*[(F.lit(float(row[c])) + F.randn(seed + i) * F.lit(float(scale[c] or 0.0))).alias(c) for i, c in enumerate(columns)])
    scored = model.transform(_features(noise, columns))
    far = sum(((F.col(c) - F.lit(float(row[c]))) / F.lit(float(scale[c] or 1.0))) ** 2 for c in columns)
    near = scored.select("features", (F.col("prediction") if regression else positive(scored)).alias("_o"), F.exp(-far / (2 * 0.75**2 * len(columns))).alias("_w"))
    fit = R.LinearRegression(featuresCol="features", labelCol="_o", weightCol="_w", regParam=1e-3).fit(near)
    rows = sorted(((c, float(w)) for c, w in zip(columns, fit.coefficients, strict=True)), key=lambda x: (-abs(x[1]), x[0]))[:k]
    return spark.createDataFrame(rows, "feature string, weight double")


def importances(model: Model, columns: list[str]) -> dict[str, float]:
    """A fitted model's own: tree importances or absolute coefficients."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = np.abs(model.coefficients.toArray())
    return dict(zip(columns, map(float, values), strict=True))


def keep_important(scores: dict[str, float], share: float = 0.01) -> list[str]:
    """Features of at least a share of the greatest importance."""
    most = max(scores.values(), default=0.0)
    return [c for c, v in scores.items() if v >= share * most]


def eliminate(df: DataFrame, columns: list[str], fit: Callable[[DataFrame, list[str]], Model], metric: str, k: int = 3, least: int = 10) -> list[str]:
    """Recursive elimination: drop the least important tenth, score by folds, keep the best set. Tables of up to `least` columns stay as they are."""
    if len(columns) <= least:
        return columns
    step, now, best = max(1, len(columns) // 10), list(columns), None
    sign = -1 if metric in ("rmse", "mae") else 1
    while now:
        score = sign * float(np.mean([evaluate(fit(df.where(F.col("fold") != i), now).transform(_features(df.where(F.col("fold") == i), now)), metric) for i in range(k)]))
        if best is None or score >= best[0]:
            best = (score, list(now))
        if len(now) <= max(1, step):
            break
        rank = importances(fit(df, now), now)
        now = sorted(now, key=lambda c: (rank[c], c))[step:]
    return [c for c in columns if c in best[1]]
