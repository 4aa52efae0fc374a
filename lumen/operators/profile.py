"""Profiling: semantic column types, statistics, associations, quality.

Every function is one aggregation over the table, or one group-by a column; what
reaches the driver has a row a column at most.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expr import INTEGER, correlation, double, entropy, kurtosis, quantile, ratio, skewness
from .quantiles import quantiles

PERCENTILES = (1, 5, 25, 75, 95, 99)
# fixed values: names of identifiers, and the shape of a date
ID_TOKENS = {"id", "uid", "uuid", "guid"}
DATE_SHAPE = r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?Z?)?\s*$"
# end of fixed values


def _long(df: DataFrame, per_column: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregation, turned into a row a column: `per_column` holds the named expressions of each."""
    flat = {f"s{i}": F.struct(F.lit(c).alias("column"), *[e.alias(n) for n, e in exprs.items()]) for i, (c, exprs) in enumerate(per_column.items())}
    one = df.agg(*[F.array(e).alias(a) for a, e in flat.items()])
    return one.select(F.inline(F.concat(*[F.col(a) for a in flat])))


def overview(df: DataFrame) -> DataFrame:
    """column, missing_pct, n_unique (nulls apart), n_rows."""
    return _long(df, {c: {"missing_pct": ratio(F.count_if(F.col(c).isNull()) * 100.0, F.count("*")), "n_unique": F.count_distinct(F.col(c)), "n_rows": F.count("*")} for c in df.columns})


def percentiles(df: DataFrame, columns: list[str], shares: list[float], accuracy: int | None = None) -> dict[str, list[float] | None]:
    """Those of each column, exact or (one pass less) by a sketch of an accuracy."""
    if accuracy is None:
        return quantiles(df, {c: (double(c), shares) for c in columns})
    return df.agg(*[quantile(double(c), shares, accuracy).alias(f"q{i}") for i, c in enumerate(columns)]).select(*[F.col(f"q{i}").alias(c) for i, c in enumerate(columns)]).first().asDict()


def numeric_stats(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Moments, extremes, percentiles, zeros, negatives and outliers of each column; `accuracy` trades exact percentiles for fewer passes."""
    shares = (*PERCENTILES, 50)
    q = percentiles(df, columns, [v / 100 for v in shares], accuracy)
    exprs = {}
    for c in columns:
        x = double(c)
        at = dict(zip(shares, q[c] or [None] * len(shares), strict=True))
        lo, hi = fence([at[25], at[75]])
        p = [F.lit(v).cast("double") for v in at.values()]
        exprs[c] = {
            "count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "median": p[len(PERCENTILES)],
            "skew": skewness(x), "kurtosis": kurtosis(x), "n_zeros": F.count_if(x == 0), "n_negatives": F.count_if(x < 0),
            "n_outliers_iqr": F.count_if((x < lo) | (x > hi)), **{f"p{v}": p[j] for j, v in enumerate(PERCENTILES)},
        }
    return _long(df, exprs)


def fence(q: list[float] | None) -> tuple[Column, Column]:
    """Bounds of the interquartile rule; null for a column without values."""
    if not q or q[0] is None:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    return F.lit(q[0] - 1.5 * (q[1] - q[0])), F.lit(q[1] + 1.5 * (q[1] - q[0]))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value (as text), n; nulls apart."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties to the smaller value."""
    return value_counts(df, column).orderBy(F.desc("n"), "value").limit(k)


def categorical_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, unique_count, cardinality_ratio, entropy (bits), mode (ties to the smaller value), mode_frequency, n_rare (values under 1 %)."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = rows.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.join(F.broadcast(total), "column").groupBy("column").agg(
        F.count("*").alias("unique_count"), (F.count("*") / F.first("total")).alias("cardinality_ratio"), F.sum(entropy(p)).alias("entropy"),
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"), F.max(p).alias("mode_frequency"), F.count_if(p < 0.01).alias("n_rare"),
    )


def rare_values(df: DataFrame, column: str, share: float = 0.01, k: int = 20) -> DataFrame:
    """The first k values below a share of the non-null rows, most frequent first."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).where(F.col("n") < share * F.col("total")).orderBy(F.desc("n"), "value").limit(k).select("value", "n")


def datetime_stats(df: DataFrame, column: str) -> DataFrame:
    """min_date, max_date, range_days (whole days), modal dayofweek (Monday 0) and month; ties to the smaller."""
    t = F.col(column)
    base = df.agg(F.min(t).alias("min_date"), F.max(t).alias("max_date"), F.floor((F.unix_seconds(F.max(t).cast("timestamp")) - F.unix_seconds(F.min(t).cast("timestamp"))) / 86400).alias("range_days"))
    mode = lambda e, name: df.where(t.isNotNull()).groupBy(e.alias(name)).agg(F.count("*").alias("n")).agg(F.min_by(name, F.struct(-F.col("n"), name)).alias(name))
    return base.join(F.broadcast(mode(F.weekday(t), "modal_dow"))).join(F.broadcast(mode(F.month(t), "modal_month")))


def text_stats(df: DataFrame, column: str) -> DataFrame:
    """avg_length, min_length, max_length, vocabulary_size (distinct words between white space)."""
    t = F.col(column)
    words = df.select(F.explode(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")).alias("w")).where("w <> ''").agg(F.count_distinct("w").alias("vocabulary_size"))
    return df.agg(F.avg(F.length(t)).alias("avg_length"), F.min(F.length(t)).alias("min_length"), F.max(F.length(t)).alias("max_length")).join(F.broadcast(words))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """value, n, share, imbalance (least over greatest class; 1 for one class), is_binary."""
    counts = value_counts(df, target)
    whole = counts.agg(F.sum("n").alias("_t"), (F.min("n") / F.max("n")).alias("imbalance"), (F.count("*") == 2).alias("is_binary"))
    return counts.join(F.broadcast(whole)).select("value", "n", (F.col("n") / F.col("_t")).alias("share"), "imbalance", "is_binary")


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """mean, std, skew, log_benefit (skew over 1) of a numeric target."""
    y = double(target)
    return df.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), skewness(y).alias("skew")).withColumn("log_benefit", F.coalesce(F.col("skew") > 1, F.lit(False)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair in the order given, over the rows that hold both; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[correlation(double(a), double(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def association(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """column, phi2: chi-square over n of each column against a categorical target, with continuity correction in 2 x 2 tables; nulls count as MISSING."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("MISSING"))
    rows = df.where(F.col(target).isNotNull()).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("x"), F.col(target).cast("string").alias("y")) for c in columns])).alias("r")).select("r.*")
    cells = rows.groupBy("column", "x", "y").agg(F.count("*").alias("o"))
    rx = cells.groupBy("column", "x").agg(F.sum("o").alias("nx"))
    ry = cells.groupBy("column", "y").agg(F.sum("o").alias("ny"))
    whole = rx.groupBy("column").agg(F.sum("nx").alias("n"), F.count("*").alias("kx")).join(ry.groupBy("column").agg(F.count("*").alias("ky")), "column")
    grid = rx.join(ry, "column").join(whole, "column").join(cells, ["column", "x", "y"], "left")
    o, e = F.coalesce("o", F.lit(0)).cast("double"), F.col("nx") * F.col("ny") / F.col("n")
    gap = F.abs(o - e)
    fixed = F.when((F.col("kx") == 2) & (F.col("ky") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return grid.groupBy("column").agg((F.sum(fixed * fixed / e) / F.first("n")).alias("phi2"), F.first("n").alias("n"))


def missing(df: DataFrame) -> DataFrame:
    """column, missing_pct (2 digits), recommendation: drop over 30, advanced_imputation over 5, simple_imputation over 0."""
    pct = F.col("missing_pct")
    return overview(df).select("column", F.round("missing_pct", 2).alias("missing_pct"), F.when(pct > 30, "drop").when(pct > 5, "advanced_imputation").when(pct > 0, "simple_imputation").otherwise("none").alias("recommendation"))


def co_missing(df: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """a, b, r: pairs of columns whose nulls go together."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    return correlations(flags, columns).where(F.col("r") > least)


def outliers(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """column, n_iqr, n_z (over three population deviations), recommendation (clip if over 1 % lie outside the fence)."""
    q = percentiles(df, columns, [0.25, 0.75], accuracy)
    first = df.agg(*[e for i, c in enumerate(columns) for e in (F.avg(double(c)).alias(f"m{i}"), F.stddev_pop(double(c)).alias(f"s{i}"))]).first()
    exprs = {}
    for i, c in enumerate(columns):
        x = double(c)
        lo, hi = fence(q[c])
        n_iqr = F.count_if((x < lo) | (x > hi))
        z = F.abs(F.try_divide(x - F.lit(first[f"m{i}"]), F.lit(first[f"s{i}"])))
        exprs[c] = {"n_iqr": n_iqr, "n_z": F.count_if(z > 3), "recommendation": F.when(ratio(n_iqr.cast("double"), F.count(x)) > 0.01, "clip").otherwise("none")}
    return _long(df, exprs)


def duplicate_ratio(df: DataFrame) -> DataFrame:
    """Share of rows that repeat an earlier one."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(F.coalesce(1 - ratio(F.count("*").cast("double"), F.sum("_n")), F.lit(0.0)).alias("duplicate_ratio"))


def quality(df: DataFrame, dates: list[str], order: str, as_of: str) -> DataFrame:
    """completeness, uniqueness, type_consistency, validity, timeliness (null without dates), score: 0 to 100.

    `order` fixes which 100 values of a text column are probed for mixed types;
    `as_of` is the day that timeliness counts from.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    n = df.count()
    if not n:
        raise ValueError("an empty table has no quality")
    q = percentiles(df, numbers, [0.25, 0.75])
    wild = [F.count_if((double(c) < fence(q[c])[0]) | (double(c) > fence(q[c])[1])).alias(f"w{i}") for i, c in enumerate(numbers)]
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns]) / (F.count("*") * len(df.columns))
    last = [F.max(F.col(dates[-1])).alias("last")] if dates else []
    got = df.agg(nulls.alias("nulls"), *wild, *last)
    mixed = F.lit(0)
    for c in texts:
        probe = df.where(F.col(c).isNotNull()).orderBy(order).limit(100)
        both = probe.agg((F.bool_or(F.col(c).rlike(r"^-?\d+\.?\d*$")) & F.bool_or(F.col(c).rlike("^[A-Za-z]"))).alias(f"mixed_{c}"))
        got = got.join(F.broadcast(both))
        mixed = mixed + F.coalesce(F.col(f"mixed_{c}").cast("int"), F.lit(0))
    got = got.join(F.broadcast(duplicate_ratio(df)))
    bad = reduce(lambda a, b: a + b, [(F.col(f"w{i}") > 0.1 * n).cast("int") for i in range(len(numbers))], F.lit(0))
    parts = {
        "completeness": F.greatest(F.lit(0.0), 100 * (1 - F.col("nulls"))), "uniqueness": 100 * (1 - F.col("duplicate_ratio")),
        "type_consistency": (95 - 5 * mixed).cast("double"), "validity": (90 - 2 * bad).cast("double"),
        "timeliness": F.greatest(F.lit(50.0), 100 - F.datediff(F.lit(as_of).cast("date"), F.col("last")) / 365 * 10) if dates else F.lit(None).cast("double"),
    }
    weight = {"completeness": 0.3, "uniqueness": 0.2, "type_consistency": 0.2, "validity": 0.2} | ({"timeliness": 0.1} if dates else {})
    out = got.select(*[e.alias(k) for k, e in parts.items()])
    score = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in weight.items()]) / sum(weight.values())
    return out.withColumn("score", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 1))


def name_tokens(name: str) -> set[str]:
    """Lower-case words of a column name, split at separators and at capitals."""
    return {t.lower() for t in re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", name) if t}


def semantic_types(df: DataFrame, target: str | None = None, order: str | None = None) -> dict[str, str]:
    """BINARY, ID, DATETIME, TEXT, CATEGORICAL or NUMERICAL for each column, decided from one aggregation (and 20 values of each text column, the first by `order`)."""
    n = "n"
    exprs = [F.count("*").alias(n)]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for i, (c, k) in enumerate(kinds.items()):
        col = F.col(c)
        exprs.append(F.count(col).alias(f"c{i}"))
        # only these kinds are told by how many values differ
        if isinstance(k, INTEGER) or (isinstance(k, T.NumericType) if c == target else isinstance(k, T.StringType)):
            exprs.append(F.count_distinct(col).alias(f"u{i}"))
        if isinstance(k, T.NumericType):
            exprs += [F.min(col).alias(f"lo{i}"), F.max(col).alias(f"hi{i}"), F.count_if(~col.isin(0, 1)).alias(f"other{i}")]
        elif isinstance(k, T.StringType):
            exprs.append(F.avg(F.length(col)).alias(f"len{i}"))
    got = df.agg(*exprs).first().asDict()
    out = {}
    for i, (c, k) in enumerate(kinds.items()):
        rows, unique, there = got[n], got.get(f"u{i}"), got[f"c{i}"]
        whole = isinstance(k, INTEGER) and there == rows
        if c == target:
            out[c] = _target_type(k, rows, unique, whole)
        elif isinstance(k, T.BooleanType) or not there or (isinstance(k, T.NumericType) and not got[f"other{i}"]):
            out[c] = "BINARY"
        elif name_tokens(c) & ID_TOKENS or (isinstance(k, T.StringType) and unique == rows) or (whole and unique == rows and got[f"lo{i}"] == 0 and got[f"hi{i}"] == rows - 1):
            out[c] = "ID"
        elif isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[c] = "DATETIME"
        elif isinstance(k, T.StringType):
            probe = df.where(F.col(c).isNotNull())
            head = (probe.orderBy(order) if order else probe).select(c).limit(20).agg(F.avg(F.col(c).rlike(DATE_SHAPE).cast("double"))).first()[0]
            out[c] = "DATETIME" if (head or 0) >= 0.8 else "TEXT" if got[f"len{i}"] > 50 else "CATEGORICAL"
        elif isinstance(k, T.NumericType):
            out[c] = "CATEGORICAL" if whole and unique < 20 else "NUMERICAL"
        else:
            out[c] = "CATEGORICAL"
    return out


def _target_type(kind: T.DataType, rows: int, unique: int, whole: bool) -> str:
    if not isinstance(kind, T.NumericType):
        return "CATEGORICAL"
    share = unique / rows if rows else 0
    if unique > 50 or (unique > 5 and share > (0.8 if whole else 0.5)):
        return "NUMERICAL"
    return "BINARY" if unique <= 2 else "CATEGORICAL"


def suggest_metric(target_type: str, distinct: int, imbalance: float) -> str:
    """The metric of a task known by its data alone."""
    if target_type == "NUMERICAL":
        return "rmse"
    return ("roc_auc" if imbalance < 0.3 else "f1") if distinct == 2 else "f1_macro"


def check_outputs(df: DataFrame, columns: list[str], most_null: float = 0.5) -> DataFrame:
    """column, constant, null_share, ok: whether new columns are worth keeping."""
    return _long(df, {c: {"constant": F.count_distinct(F.col(c)) <= 1, "null_share": F.avg(F.col(c).isNull().cast("double"))} for c in columns}).withColumn("ok", ~F.col("constant") & (F.col("null_share") <= most_null))


def ordered_head(df: DataFrame, column: str, order: str, k: int = 5) -> DataFrame:
    """The first k non-null values by a row key."""
    return df.where(F.col(column).isNotNull()).orderBy(order).limit(k).select(F.row_number().over(Window.orderBy(order)).alias("i"), F.col(column).cast("string").alias("value"))
