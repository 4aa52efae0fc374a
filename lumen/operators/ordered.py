"""Ordered target statistics: a category's encoding of a row looks only at rows before it in a hashed permutation."""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.persist import Saved, frozen
from .features import BROADCAST_KEYS

#: Rows that a bucket of a category should hold about, and the most hexadecimal digits that name a bucket.
BUCKET_ROWS, MOST_DIGITS = 50_000, 5


def permutation(key: list[str] | None, seed: int = 42) -> Column:
    """A row's place: md5 of the seed and the key's texts (of the whole row without a key), each null as an empty text."""
    parts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key] if key else [F.to_json(F.struct("*"))]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("MISSING"))


def ordered_target(df: DataFrame, columns: list[str], target: str, key: list[str] | None = None, strength: float = 1.0, seed: int = 42, prior: float | None = None) -> DataFrame:
    """`df` with `<column>_ordered`: (sum of the target over the category's earlier rows + strength * prior) / (their number + strength).

    Rows of equal place do not see each other, so the result does not hang on an
    order among them; rows without a target count for nothing and still get a
    value. The prior is the target's mean. A category's rows are added up in
    buckets of places, whose totals are summed first, so one that holds most of
    the rows spans many tasks. Null is a category of its own.
    """
    y = F.col(f"`{target}`").cast("double")
    n, mean = df.agg(F.count("*"), F.avg(y)).first()
    prior = (mean or 0.0) if prior is None else prior
    digits = max(1, min(MOST_DIGITS, math.ceil(math.log(max(1, n) / BUCKET_ROWS, 16)) if n > BUCKET_ROWS else 1))
    out = df.withColumn("_place", permutation(key, seed))
    for i, c in enumerate(columns):
        rows = out.withColumns({"_cat": _text(c), "_bucket": F.substring("_place", 1, digits), "_y": F.coalesce(y, F.lit(0.0)), "_n": y.isNotNull().cast("long")})
        before = Window.partitionBy("_cat").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.groupBy("_cat", "_bucket").agg(F.sum("_y").alias("_ty"), F.sum("_n").alias("_tn"))
        totals = totals.select("_cat", "_bucket", F.coalesce(F.sum("_ty").over(before), F.lit(0.0)).alias("_by"), F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_bn"))
        inside, same = Window.partitionBy("_cat", "_bucket").orderBy("_place").rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("_cat", "_bucket", "_place")
        earlier = lambda v, b: F.col(b) + F.sum(v).over(inside) - F.sum(v).over(same)  # noqa: B023, E731
        value = (earlier("_y", "_by") + strength * prior) / (earlier("_n", "_bn") + strength)
        out = rows.join(totals, ["_cat", "_bucket"]).withColumn(f"_o{i}", value).drop("_cat", "_bucket", "_y", "_n", "_by", "_bn")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_o{i}").alias(f"{c}_ordered") for i, c in enumerate(columns)])


class OrderedEncoder(Estimator):
    """`fit_transform` encodes training rows by the rows before each, and gives the model that encodes new rows by all of them."""

    def __init__(self, columns: list[str], target: str, key: list[str] | None = None, strength: float = 1.0, seed: int = 42):
        super().__init__()
        self.columns, self.target, self.key, self.strength, self.seed = list(columns), target, key, strength, seed

    def _fit(self, df: DataFrame) -> OrderedModel:
        y = F.col(f"`{self.target}`").cast("double")
        prior = df.agg(F.avg(y)).first()[0] or 0.0
        pairs = df.where(y.isNotNull()).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("category")) for c in self.columns])).alias("p"), y.alias("y")).select("p.*", "y")
        table = frozen(pairs.groupBy("column", "category").agg(((F.sum("y") + self.strength * prior) / (F.count("*") + self.strength)).alias("value")))
        return OrderedModel(self.columns, prior, table)

    def fit_transform(self, df: DataFrame) -> tuple[OrderedModel, DataFrame]:
        model = self.fit(df)
        return model, ordered_target(df, self.columns, self.target, self.key, self.strength, self.seed, model.prior)


class OrderedModel(Saved, Model):
    """`<column>_ordered` of new rows; the prior for categories never seen."""

    def __init__(self, columns: list[str], prior: float, table: DataFrame):
        super().__init__()
        self.columns, self.prior, self.table = columns, prior, table

    @property
    def output_columns(self) -> list[str]:
        return [f"{c}_ordered" for c in self.columns]

    def state(self):
        return {"columns": self.columns, "prior": self.prior}, {"table": self.table}, []

    @classmethod
    def restore(cls, values, tables, parts):
        return cls(values["columns"], values["prior"], tables["table"])

    def _transform(self, df: DataFrame) -> DataFrame:
        sizes = {r["column"]: r["n"] for r in self.table.groupBy("column").agg(F.count("*").alias("n")).collect()}
        for i, c in enumerate(self.columns):
            known = self.table.where(F.col("column") == c).select(F.col("category").alias("_cat"), F.col("value").alias(f"_v{i}"))
            known = F.broadcast(known) if sizes.get(c, 0) <= BROADCAST_KEYS else known
            df = df.withColumn("_cat", _text(c)).join(known, "_cat", "left").drop("_cat").withColumn(f"{c}_ordered", F.coalesce(f"_v{i}", F.lit(float(self.prior)))).drop(f"_v{i}")
        return df
