"""Splitting, preprocessing and feature selection."""

from __future__ import annotations

import re

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import clip, double
from ..functions.persist import Saved, frozen
from .profile import correlations
from .quantiles import quantiles

#: A one-hot column has at most so many categories.
MAX_CATEGORIES = 1000
#: A vocabulary up to this size is broadcast; in a longer one a value is frequent with more than one row in FREQUENT.
BROADCAST_CLASSES, FREQUENT = 200_000, 1000


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


#: Buckets that a class's rows are ranked in.
_BUCKET_BITS = 12


def split(df: DataFrame, key: list[str], test_share: float = 0.2, by: str | None = None, seed: int = 42) -> DataFrame:
    """`df` with `is_test`, decided by a hash of the row's key.

    Without `by`, a row's side depends on that row alone and nothing is
    shuffled. With it, the round(test_share * n) rows of each class with the
    smallest hashes are test rows; a class is ranked in buckets of hashes, so
    one that holds most of the rows spans many tasks.
    """
    h = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30))
    if by is None:
        return df.withColumn("is_test", h < int(test_share * (1 << 30)))
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 30 - _BUCKET_BITS)).withColumn("_y", F.coalesce(F.col(by).cast("string"), F.lit("")))
    # at most 2^_BUCKET_BITS rows a class
    sizes = rows.groupBy("_y", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_y")
    sizes = sizes.withColumns({"_upto": F.sum("_n").over(w.orderBy("_b")), "_goal": F.round(F.sum("_n").over(w) * test_share)})
    rank = F.row_number().over(Window.partitionBy("_y", "_b").orderBy("_h", *key)) + F.col("_upto") - F.col("_n")
    out = rows.join(sizes, ["_y", "_b"]).withColumn("is_test", rank <= F.col("_goal"))
    return out.select(*df.columns, "is_test")


def _ranked(df: DataFrame, by: str | None, order: list[Column]) -> DataFrame:
    """`df` with `_rank` from 1 in a given order, and `_all`, the rows of its class of `by`; a null is a class.

    Rows are dealt to tasks by range of (class, order) and ranked there; the
    tasks' counts, a row a class and task, are added up before. So a class that
    holds most of the rows spans many tasks, unless its rows are equal in `order`.
    """
    parts = [F.col(by).alias("_y") if by else F.lit(0).alias("_y"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]]
    names = ["_y", *[f"_o{i}" for i in range(len(order))]]
    rows = frozen(df.select("*", *parts).repartitionByRange(*names).withColumn("_part", F.spark_partition_id()))
    task = Window.partitionBy("_y", "_part")
    sizes = rows.groupBy("_y", "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_y")
    sizes = sizes.select(F.col("_y").alias("_y2"), F.col("_part").alias("_part2"), (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
    ranked = rows.withColumn("_r", F.row_number().over(task.orderBy(*names[1:])))
    out = ranked.join(sizes, F.col("_y").eqNullSafe(F.col("_y2")) & (F.col("_part") == F.col("_part2")))
    return out.select(*df.columns, (F.col("_r") + F.col("_before")).alias("_rank"), "_all")


def stratified(df: DataFrame, by: str, order: list[Column], test_share: float = 0.2) -> DataFrame:
    """`is_test` for the first round(share * n) rows of each class in a given order (ascending); `split` needs no sort."""
    return _ranked(df, by, order).withColumn("is_test", F.col("_rank") <= F.round(F.col("_all") * test_share)).drop("_rank", "_all")


def kfold(df: DataFrame, order: list[Column], k: int = 5, by: str | None = None) -> DataFrame:
    """`fold` from 0 to k - 1, dealt in turn in a given order (ascending; within each class of `by`); `hash_fold` needs no sort."""
    return _ranked(df, by, order).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_all")


def hash_fold(df: DataFrame, key: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """`fold` by a hash of the row's key: no shuffle, for tables of any size."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(k)).cast("int"))


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in columns})


def label_index(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """`out`: place of the value among the sorted distinct texts; null stays null.

    The vocabulary has a row a class. Counted to be small, it is broadcast; beyond
    that it is ranked in tasks by range and joined by shuffle, and the rows of
    frequent values and of nulls stay where they are.
    """
    text = F.col(column).cast("string")
    values = frozen(df.select(text.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n")))
    if values.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        index = values.select("_v", (F.row_number().over(Window.orderBy("_v")) - 1).cast("int").alias(out))
        return df.join(F.broadcast(index), text == F.col("_v"), "left").drop("_v")
    index = frozen(_ranked(values, None, [F.col("_v")]).select("_v", "_n", (F.col("_rank") - 1).cast("int").alias(out)))
    # fewer than FREQUENT of them
    often = F.broadcast(index.where(F.col("_n") > values.agg(F.sum("_n")).first()[0] // FREQUENT).select("_v", out))
    stay = df.join(often, text == F.col("_v"), "left").where(text.isNull() | F.col("_v").isNotNull())
    dealt = df.where(text.isNotNull()).join(often, text == F.col("_v"), "left_anti").join(index.select("_v", out), text == F.col("_v"))
    return stay.unionByName(dealt).drop("_v")


def sanitise(names: list[str]) -> list[str]:
    """Names without brackets and angle brackets, made distinct by __n."""
    clean = [re.sub(r"[\[\]<>]", "_", name).strip() for name in names]
    taken, used, out = set(clean), set(), []
    for name in clean:
        new, n = name, 0
        while new in used or (n and new in taken):
            n += 1
            new = f"{name}__{n}"
        used.add(new)
        out.append(new)
    return out


def select_names(df: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns that exist; all, if none is named."""
    found = [c for c in keep if c in df.columns]
    return df.select(*found) if found else df


class Preprocessor(Estimator):
    """Clip, impute and scale numbers; fill and one-hot encode categories. `fit` is percentiles of bounded memory, one aggregation and one distinct."""

    def __init__(self, numeric: list[str], categorical: list[str], clipped: list[str] = (), keep: list[str] = (), indicators: bool = False):
        super().__init__()
        self.numeric, self.categorical, self.clipped, self.keep, self.indicators = list(numeric), list(categorical), list(clipped), list(keep), indicators

    def _fit(self, df: DataFrame) -> PreprocessorModel:
        return fit_parts(df, [self], [F.lit(True)])[0]


def fit_parts(df: DataFrame, specs: list[Preprocessor], parts: list[Column]) -> list[PreprocessorModel]:
    """A model a spec, each learned on its own part of the rows only, in passes that all share. The last part should be the widest, as its sketches serve the others."""
    wanted: dict[str, list[int]] = {}
    for i, s in enumerate(specs):
        for c in dict.fromkeys([*s.numeric, *s.clipped]):
            wanted.setdefault(c, []).append(i)
    # the median of clipped values is that of the values
    asked = {(i, c): (F.when(parts[i], double(c)), [0.01, 0.5, 0.99] if c in specs[i].clipped else [0.5]) for c, at in wanted.items() for i in at}
    found = quantiles(df, asked, {(i, c): (at[-1], c) for c, at in wanted.items() for i in at[:-1]})
    bounds = [{c: [found[i, c][0], found[i, c][-1]] for c in s.clipped if found[i, c]} for i, s in enumerate(specs)]
    medians = [{c: found[i, c][len(found[i, c]) // 2] if found[i, c] else None for c in s.numeric} for i, s in enumerate(specs)]
    sums = []
    for i, s in enumerate(specs):
        for j, c in enumerate(s.numeric):
            x = F.coalesce(clip(double(c), *bounds[i][c]) if c in bounds[i] else double(c), F.lit(medians[i][c]))
            sums += [F.avg(F.when(parts[i], x)).alias(f"m{i}_{j}"), F.stddev_pop(F.when(parts[i], x)).alias(f"s{i}_{j}")]
    got = df.agg(*sums).first().asDict() if sums else {}
    scale = [{f"{k}_{c}": got[f"{k}{i}_{j}"] for j, c in enumerate(s.numeric) for k in "ms"} for i, s in enumerate(specs)]
    return [PreprocessorModel(s, bounds[i], medians[i], scale[i], v) for i, (s, v) in enumerate(zip(specs, _vocabularies(df, specs, parts), strict=True))]


def _vocabularies(df: DataFrame, specs: list[Preprocessor], parts: list[Column]) -> list[dict[str, list[str]]]:
    columns = list(dict.fromkeys(c for s in specs for c in s.categorical))
    out: list[dict[str, list[str]]] = [{} for _ in specs]
    if not columns:
        return out
    within = F.array(*[F.coalesce(p, F.lit(False)) for p in parts])
    seen = df.select(within.alias("w"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _category(c).alias("v")) for c in columns])).alias("p")).select("w", "p.*").distinct()
    # which parts hold a value, a row a value
    held = seen.groupBy("c", "v").agg(*[F.bool_or(F.col("w")[i] & F.col("c").isin(s.categorical)).alias(f"w{i}") for i, s in enumerate(specs)])
    held = held.where(F.greatest(*[F.col(f"w{i}") for i in range(len(specs))], F.lit(False)))
    # with more rows than this, some part has too many of some column
    for r in held.limit(MAX_CATEGORIES * len(columns) * len(specs) + 1).collect():
        for i in range(len(specs)):
            if r[f"w{i}"]:
                out[i].setdefault(r["c"], []).append(r["v"])
    for c, values in ((c, v) for o in out for c, v in o.items()):
        if len(values) > MAX_CATEGORIES:
            raise ValueError(f"{c!r} has over {MAX_CATEGORIES} categories; encode it by frequency or target instead")
    return [{c: sorted(v) for c, v in o.items()} for o in out]


def _category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("MISSING"))


class PreprocessorModel(Saved, Model):
    """Replays what was learned: one select, no shuffle. Categories never seen encode as zeros."""

    def __init__(self, spec: Preprocessor, bounds: dict, medians: dict, scale: dict, vocabulary: dict[str, list[str]]):
        super().__init__()
        self.spec, self.bounds, self.medians, self.scale, self.vocabulary = spec, bounds, medians, scale, vocabulary

    def state(self):
        s = self.spec
        spec = {"numeric": s.numeric, "categorical": s.categorical, "clipped": s.clipped, "keep": s.keep, "indicators": s.indicators}
        return {"spec": spec, "bounds": self.bounds, "medians": self.medians, "scale": self.scale, "vocabulary": self.vocabulary}, {}, []

    @classmethod
    def restore(cls, values, tables, parts):
        return cls(Preprocessor(**values["spec"]), values["bounds"], values["medians"], values["scale"], values["vocabulary"])

    @property
    def output_columns(self) -> list[str]:
        hot = [f"{c}_{v}" for c in self.spec.categorical for v in self.vocabulary.get(c, [])]
        flags = [f"{c}_is_missing" for c in self.spec.numeric] if self.spec.indicators else []
        return sanitise([*self.spec.numeric, *flags, *hot])

    def expressions(self) -> list[Column]:
        """What `output_columns` hold."""
        out: list[Column] = []
        for c in self.spec.numeric:
            x = clip(double(c), *self.bounds[c]) if c in self.bounds else double(c)
            m, s = self.scale[f"m_{c}"], self.scale[f"s_{c}"]
            out.append((F.coalesce(x, F.lit(self.medians[c])) - F.lit(m)) / F.lit(s if s else 1.0))
        if self.spec.indicators:
            out += [F.col(c).isNull().cast("double") for c in self.spec.numeric]
        return out + [(_category(c) == v).cast("double") for c in self.spec.categorical for v in self.vocabulary.get(c, [])]

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.spec.keep, *[e.alias(n) for e, n in zip(self.expressions(), self.output_columns, strict=True)])


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Nulls filled with the most frequent value, ties to the smaller one."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias("_mode"))
    return df.join(F.broadcast(top)).withColumn(column, F.coalesce(column, "_mode")).drop("_mode")


def correlation_filter(df: DataFrame, features: list[str], target: str, most: float = 0.95) -> list[tuple[str, str, float]]:
    """(dropped, kept, r): of each pair correlated beyond `most`, in order, the one less correlated with the target goes; a tie drops the second."""
    pairs = {(r["a"], r["b"]): r["r"] for r in correlations(df, [*features, target]).collect()}
    with_y = {f: abs(pairs.get((f, target)) or 0.0) for f in features}
    gone: dict[str, tuple[str, float]] = {}
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            r = pairs.get((a, b))
            if a in gone or b in gone or r is None or abs(r) <= most:
                continue
            drop, keep = (a, b) if with_y[a] < with_y[b] else (b, a)
            gone[drop] = (keep, r)
    return [(d, k, r) for d, (k, r) in gone.items()]


def binned_mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """feature, mi (nats): from the contingency table of equal-width bins and the target. An approximation of the nearest-neighbour estimate."""
    return information_of_parts(df, features, target, [F.lit(True)], bins).drop("part")


def information_of_parts(df: DataFrame, features: list[str], target: str, parts: list[Column], bins: int = 10) -> DataFrame:
    """part, feature, mi: `binned_mutual_information` within each part of the rows, counted in one pass for all."""
    ends = df.agg(*[e for k, p in enumerate(parts) for i, c in enumerate(features) for e in (F.min(F.when(p, double(c))).alias(f"lo{k}_{i}"), F.max(F.when(p, double(c))).alias(f"hi{k}_{i}"))]).first()

    def bin_of(k: int, i: int, c: str) -> Column:
        lo, hi = ends[f"lo{k}_{i}"], ends[f"hi{k}_{i}"]
        if lo is None or hi == lo:
            return F.when(parts[k] & F.col(c).isNotNull(), F.lit(0))
        return F.when(parts[k], F.least(F.floor((double(c) - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int"))

    at = [f"x{k}" for k in range(len(parts))]
    each = [F.struct(F.lit(i).alias("i"), *[bin_of(k, i, c).alias(x) for k, x in enumerate(at)]) for i, c in enumerate(features)]
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("y") if len(parts) == 1 else F.col(target).alias("y"), F.explode(F.array(*each)).alias("r"))
    counts = rows.select("y", "r.*").groupBy("i", *at, "y").agg(F.count("*").alias("n"))
    if len(parts) > 1:
        counts = frozen(counts)
    cells = counts.select(F.element_at(F.array(*[F.lit(c) for c in features]), F.col("i") + 1).alias("feature"), F.col("y").cast("string").alias("y"), "n", F.posexplode(F.array(*at)).alias("part", "x")).where("x is not null")
    cells = cells.groupBy("part", "feature", "x", "y").agg(F.sum("n").alias("n"))
    x = cells.groupBy("part", "feature", "x").agg(F.sum("n").alias("nx"))
    y = cells.groupBy("part", "feature", "y").agg(F.sum("n").alias("ny"))
    t = cells.groupBy("part", "feature").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return cells.join(x, ["part", "feature", "x"]).join(y, ["part", "feature", "y"]).join(t, ["part", "feature"]).groupBy("part", "feature").agg(F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")).cast("double"))).alias("mi"))


def select_by_information(scores: DataFrame, least: float = 0.01, fallback: int = 10) -> list[str]:
    """Features at or above `least`; if none is, the best `fallback`."""
    rows = scores.orderBy(F.desc("mi"), "feature").collect()
    return [r["feature"] for r in rows if r["mi"] >= least] or [r["feature"] for r in rows[:fallback]]
