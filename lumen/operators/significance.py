"""Paired comparisons: McNemar, Holm, and the bootstrap."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.persist import frozen

EXACT_BELOW = 25
#: Replicates a task draws; the statistics of a replicate are all that leaves it.
REPLICATES_A_TASK = 250


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """b, c (rows that only the first, only the second gets right), statistic, exact: the smaller count below 25 discordant rows, else chi-square with continuity correction."""
    right_a, right_b = F.col(a) == F.col(y), F.col(b) == F.col(y)
    s = df.agg(F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c"))
    n = F.col("b") + F.col("c")
    chi = F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, F.lit(2.0)), n)
    return s.select("b", "c", F.when(n < EXACT_BELOW, F.least("b", "c").cast("double")).otherwise(chi).alias("statistic"), (n < EXACT_BELOW).alias("exact"))


def mcnemar_p(b: int, c: int) -> float:
    """p-value from the discordant counts."""
    n = b + c
    if not n:
        return 1.0
    if n < EXACT_BELOW:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))


def holm(df: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """`df` with `reject`: step-down over the comparisons, a small table, ties by key."""
    w = Window.orderBy(p, key)
    passed = (F.col(p) <= alpha / (F.count("*").over(Window.partitionBy()) - F.row_number().over(w) + 1)).cast("int")
    return df.withColumn("_ok", passed).withColumn("reject", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok")


def bootstrap_difference(a: np.ndarray, b: np.ndarray, replicates: int = 2000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float, float]:
    """Difference of means of paired scores (a few folds) and its percentile interval."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if len(a) != len(b) or len(a) < 2:
        raise ValueError("two or more paired scores are needed")
    rng = np.random.default_rng(seed)
    gap, out, block = a - b, [], max(1, 8_000_000 // len(a))
    for lo in range(0, replicates, block):
        out.append(gap[rng.integers(0, len(a), size=(min(block, replicates - lo), len(a)))].mean(axis=1))
    lo, hi = np.quantile(np.concatenate(out), [alpha / 2, 1 - alpha / 2])
    return float(gap.mean()), float(lo), float(hi)


def ties(scores: dict[str, list[float]], replicates: int = 2000, seed: int = 42, lower: bool = False) -> tuple[str, list[str]]:
    """The leader by mean fold score and the models whose gap to it may be zero."""
    mean = {m: float(np.mean(s)) * (-1 if lower else 1) for m, s in scores.items()}
    leader = min(mean, key=lambda m: (-mean[m], m))
    tied = [m for m in scores if m == leader or (lambda i: i[1] <= 0 <= i[2])(bootstrap_difference(np.array(scores[leader]), np.array(scores[m]), replicates, seed=seed))]
    return leader, sorted(tied)


#: Metrics that sums over rows give, and so a bootstrap of the rows.
SUMMED = ("accuracy", "f1", "f1_macro", "rmse", "mae")


def _parts(metric: str, y: str, m: str, labels: list) -> dict[str, Column]:
    """What a row adds to the sums of a model's metric."""
    said, true = F.col(f"`{m}`"), F.col(f"`{y}`")
    if metric == "accuracy":
        return {"hit": said == true}
    if metric in ("rmse", "mae"):
        return {"error": F.pow(said - true, F.lit(2.0)) if metric == "rmse" else F.abs(said - true)}
    out = {}
    for i, label in enumerate([1] if metric == "f1" else labels):
        one, is_ = F.coalesce(said == label, F.lit(False)), true == label
        out |= {f"tp{i}": one & is_, f"fp{i}": one & ~is_, f"fn{i}": ~one & is_}
    return out


def _score(metric: str, labels: list) -> Column:
    """The metric from the sums; higher is better, so errors are negative. Null where it is undefined."""
    if metric == "accuracy":
        return F.try_divide("hit", "n")
    if metric in ("rmse", "mae"):
        mean = F.try_divide("error", "n")
        return -(F.sqrt(mean) if metric == "rmse" else mean)
    each = [F.try_divide(2 * F.col(f"tp{i}"), 2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")) for i in range(1 if metric == "f1" else len(labels))]
    if metric == "f1":
        return each[0]
    # a class that a draw left out of labels and predictions has no part in its mean
    there = [F.coalesce(e, F.lit(0.0)) for e in each]
    return F.try_divide(sum(there[1:], there[0]), sum((e.isNotNull().cast("int") for e in each[1:]), each[0].isNotNull().cast("int")))


def _resampled(df: DataFrame, y: str, names: list[str], metric: str, labels: list, replicates: int, seed: int) -> DataFrame:
    """model, replicate, n and v, the model's metric over Poisson(1) draws of the rows.

    All models see the same draws, and only sums a replicate are shuffled. Errors
    are resampled where their rows are, by a generator seeded by the partition.
    For counts, rows of equal label and predictions are counted first: draws of n
    such rows sum to one Poisson(n) draw, seeded by the label and predictions.
    """
    if metric not in SUMMED:
        raise ValueError(f"no bootstrap of {metric!r}; offered are {', '.join(SUMMED)}")
    blocks = -(-replicates // REPLICATES_A_TASK)
    parts = [_parts(metric, y, m, labels) for m in names]
    sums = list(parts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        got, n = np.zeros((replicates, len(sums) * len(names))), np.zeros(replicates)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]).astype(float)
            if counted:
                for hashed, rows, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), x, strict=True):
                    w = np.random.default_rng([seed, hashed % (1 << 64)]).poisson(rows, size=replicates)
                    got += np.outer(w, one)
                    n += w
                continue
            for lo in range(0, len(x), 1000):
                part = x[lo : lo + 1000]
                for block in range(blocks):
                    a, b = block * REPLICATES_A_TASK, min(replicates, (block + 1) * REPLICATES_A_TASK)
                    w = rng.poisson(1.0, size=(b - a, len(part)))
                    got[a:b] += w @ part
                    n[a:b] += w.sum(axis=1)
        for j, m in enumerate(names):
            own = [pa.array(got[:, j * len(sums) + i]) for i in range(len(sums))]
            yield pa.RecordBatch.from_arrays([pa.array([m] * replicates), pa.array(np.arange(replicates)), pa.array(n), *own], names=["model", "replicate", "n", *sums])

    adds = [F.coalesce(e.cast("double"), F.lit(0.0)).alias(f"s{j}_{i}") for j, p in enumerate(parts) for i, e in enumerate(p.values())]
    counted = metric not in ("rmse", "mae")
    alike = df.groupBy(*[F.col(f"`{c}`") for c in (y, *names)]).agg(F.count("*").alias("_rows")) if counted else df.withColumn("_rows", F.lit(1))
    key = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in (y, *names)]) if counted else F.lit(0).cast("long")
    drawn = alike.select(key.alias("_key"), F.col("_rows").cast("long"), *adds).mapInArrow(run, f"model string, replicate long, n double, {', '.join(f'{c} double' for c in sums)}")
    return drawn.groupBy("model", "replicate").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).withColumn("v", _score(metric, labels))


def bootstrap_counts(df: DataFrame, y: str, predictions: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """model, mean, low, high: accuracy and its 95 % interval by a Poisson bootstrap of the rows."""
    scores = _resampled(df, y, list(predictions), "accuracy", [], replicates, seed)
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return scores.groupBy("model").agg(F.avg("v").alias("mean"), q[0].alias("low"), q[1].alias("high"))


def tied(df: DataFrame, y: str, predictions: list[str], metric: str = "accuracy", replicates: int = 1000, alpha: float = 0.05, seed: int = 42, labels: list = ()) -> DataFrame:
    """model, mean, low, high, is_leader, tied: of the leader's score less each model's, the interval by a paired bootstrap of the rows.

    The leader has the best mean score (ties to the smaller name); errors count
    as negative scores. A model is tied if its interval holds 0. f1 is that of
    label 1, f1_macro the mean over `labels`. A replicate in which any model's
    metric is undefined counts for none; fewer than half of them left is an error.
    """
    scores = _resampled(df, y, list(predictions), metric, list(labels), replicates, seed)
    whole = frozen(scores.groupBy("replicate").agg(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("model", "v"))).alias("s")).where(F.size("s") == len(predictions)))
    if 2 * whole.count() < replicates:
        raise ValueError(f"{metric} is undefined in over half of the replicates")
    each = whole.select("replicate", F.inline("s"))
    leader = each.groupBy("model").agg(F.avg("v").alias("m")).orderBy(F.desc("m"), "model").first()["model"]
    best = each.where(F.col("model") == leader).select("replicate", F.col("v").alias("best"))
    q = F.percentile(F.col("best") - F.col("v"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    gaps = each.join(best, "replicate").groupBy("model").agg(F.avg("v").alias("mean"), q.alias("q"))
    out = gaps.select("model", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), (F.col("model") == leader).alias("is_leader"))
    return out.withColumn("tied", (F.col("low") <= 0) & (F.col("high") >= 0))


def metric_by_group(df: DataFrame, group: str, y: str, p: str, metric: Callable[[Column, Column], Column]) -> DataFrame:
    """group, value of a caller's metric on each group's labels and predictions: an expression of aggregates, so no task holds a group."""
    return df.groupBy(F.col(group).cast("string").alias("g")).agg(metric(F.col(y), F.col(p)).cast("double").alias("value"))
