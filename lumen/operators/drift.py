"""Drift against a baseline, and serving statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import double, is_numeric, quantile

BINS, FLOOR, DRIFTED = 10, 0.001, 0.25


def _psi(cells: DataFrame) -> DataFrame:
    """column, psi from column, cell, e, a (shares): floored, renormalised."""
    c = cells.select("column", F.greatest("e", F.lit(FLOOR)).alias("e"), F.greatest("a", F.lit(FLOOR)).alias("a"))
    s = c.groupBy("column").agg(F.sum("e").alias("se"), F.sum("a").alias("sa"))
    e, a = F.col("e") / F.col("se"), F.col("a") / F.col("sa")
    return c.join(s, "column").groupBy("column").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def psi_numeric(baseline: DataFrame, current: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """column, psi over equal-width bins of the baseline's range; current values outside it are in no bin but count as rows. A side without values, or a range without width, gives 0."""
    ends = baseline.agg(*[e for i, c in enumerate(columns) for e in (F.min(double(c)).alias(f"lo{i}"), F.max(double(c)).alias(f"hi{i}"))]).first()
    edges = {}
    for i, c in enumerate(columns):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is not None and hi > lo:
            step = (hi - lo) / bins
            edges[c] = [lo - 1e-6, *[lo + step * k for k in range(1, bins)], hi + 1e-6]

    def shares(df: DataFrame, name: str) -> DataFrame:
        cells = []
        for c, e in edges.items():
            x, n = double(c), F.count(double(c))
            for k in range(bins):
                inside = (x >= e[k]) & (x <= e[k + 1] if k == bins - 1 else x < e[k + 1])
                cells.append(F.struct(F.lit(c).alias("column"), F.lit(k).alias("cell"), F.try_divide(F.count_if(inside).cast("double"), n).alias(name)))
        return df.agg(F.array(*cells).alias("x")).select(F.inline("x"))

    flat = [c for c in columns if c not in edges]
    out = None
    if edges:
        both = shares(baseline, "e").join(shares(current, "a"), ["column", "cell"]).where("e is not null and a is not null")
        out = _psi(both)
        empty = [c for c in edges]
        names = baseline.sparkSession.createDataFrame([(c,) for c in empty], "column string")
        out = names.join(out, "column", "left").select("column", F.coalesce("psi", F.lit(0.0)).alias("psi"))
    if flat:
        rest = baseline.sparkSession.createDataFrame([(c, 0.0) for c in flat], "column string, psi double")
        out = rest if out is None else out.union(rest)
    return out


def psi_categorical(baseline: DataFrame, current: DataFrame, columns: list[str], other: bool = False) -> DataFrame:
    """column, psi over the baseline's categories. New ones are left out, or gathered in one more cell with `other`. A side without values gives 0."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns])).alias("r")).select("r.*").where("cell is not null")
        n = rows.groupBy("column", "cell").agg(F.count("*").alias("n"))
        return n.join(n.groupBy("column").agg(F.sum("n").alias("t")), "column").select("column", "cell", (F.col("n") / F.col("t")).alias(name))

    e, a = shares(baseline, "e"), shares(current, "a")
    there = a.select("column").distinct().withColumn("_some", F.lit(True))
    cells = e.join(a, ["column", "cell"], "left").select("column", "cell", "e", F.coalesce("a", F.lit(0.0)).alias("a"))
    if other:
        new = a.join(e.select("column", "cell"), ["column", "cell"], "left_anti").groupBy("column").agg(F.sum("a").alias("a"))
        cells = cells.union(new.select("column", F.lit(None).cast("string"), F.lit(0.0), "a"))
    names = baseline.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    found = _psi(cells.join(there, "column", "left_semi"))
    return names.join(found, "column", "left").select("column", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def drift_report(baseline: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, psi (4 digits), drifted (over 0.25 before rounding), overall (mean of the rounded) for the columns that both tables have."""
    common = [c for c in (columns or baseline.columns) if c in baseline.columns and c in current.columns]
    numeric = [c for c in common if is_numeric(baseline, c)]
    rest = [c for c in common if c not in numeric and isinstance(baseline.schema[c].dataType, (T.StringType, T.BooleanType))]
    parts = ([psi_numeric(baseline, current, numeric)] if numeric else []) + ([psi_categorical(baseline, current, rest)] if rest else [])
    if not parts:
        raise ValueError("the tables share no column that drift can be measured on")
    rows = reduce(lambda a, b: a.union(b), parts).select("column", F.round("psi", 4).alias("psi"), (F.col("psi") > DRIFTED).alias("drifted"))
    overall = rows.agg(F.avg("psi").alias("overall"))
    return rows.join(F.broadcast(overall))


def serving_summary(df: DataFrame, latency: str, error: Column, confidence: str | None = None, latest: int | None = None, at: str | None = None) -> DataFrame:
    """requests, errors, error_rate, p50, p95, p99 (of requests without error), avg_confidence; over the `latest` requests by `at`, if given."""
    rows = df.orderBy(F.desc(at)).limit(latest) if latest else df
    q = quantile(F.when(~error, double(latency)), [0.5, 0.95, 0.99])
    return rows.agg(F.count("*").alias("requests"), F.count_if(error).alias("errors"), F.try_divide(F.count_if(error).cast("double"), F.count("*")).alias("error_rate"), q[0].alias("p50"), q[1].alias("p95"), q[2].alias("p99"), (F.avg(F.when(~error, double(confidence))) if confidence else F.lit(None).cast("double")).alias("avg_confidence"))


def prediction_distribution(df: DataFrame, prediction: str) -> DataFrame:
    n = df.groupBy(F.col(prediction).cast("string").alias("prediction")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_t")))).select("prediction", "n", (F.col("n") / F.col("_t")).alias("share"))
