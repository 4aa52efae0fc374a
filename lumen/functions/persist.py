"""Saving fitted models as folders of tables, and loading them again without their training data."""

from __future__ import annotations

import importlib
import json
import tempfile
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS: dict[str, type[Saved]] = {}


class Saved:
    """A model whose state is plain values, tables and other models.

    `state` gives (values, tables, parts) and `restore` builds the model from
    them: values hold what JSON can, tables are DataFrames, parts are models.
    """

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        _KINDS[cls.__name__] = cls

    def state(self) -> tuple[dict[str, Any], dict[str, DataFrame], list[Transformer]]:
        raise NotImplementedError

    @classmethod
    def restore(cls, values: dict[str, Any], tables: dict[str, DataFrame], parts: list[Transformer]) -> Saved:
        raise NotImplementedError

    def save(self, path: str) -> None:
        save(self, path)


def working_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumen-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"


def frozen(table: DataFrame) -> DataFrame:
    """`table` as it is now, written once: later changes of its source do not reach it."""
    working_folder(table.sparkSession)
    return table.checkpoint()


def written(table: DataFrame) -> DataFrame:
    """`frozen`, as Parquet: what reads it later reads its own columns only. Types that Parquet lacks leave it to `frozen`."""
    spark = table.sparkSession
    path = new_folder(spark, "table")
    try:
        table.write.parquet(path)
    except AnalysisException:
        return frozen(table)
    return spark.read.schema(table.schema).parquet(path)


def save(model: Transformer, path: str) -> None:
    """Write a model below `path`. Its description comes last, so a save that broke off cannot be loaded."""
    if isinstance(model, PipelineModel):
        kind, values, tables, parts = "pipeline", {}, {}, list(model.stages)
    elif isinstance(model, Saved):
        kind, (values, tables, parts) = type(model).__name__, model.state()
    elif hasattr(model, "write") and type(model).__module__.startswith("pyspark.ml."):
        kind, values, tables, parts = "spark", {"module": type(model).__module__, "name": type(model).__name__}, {}, []
        model.write().overwrite().save(f"{path}/model")
    else:
        raise ValueError(f"{type(model).__name__} cannot be saved")
    spark = SparkSession.active()
    for i, table in enumerate(tables.values()):
        table.write.mode("overwrite").parquet(f"{path}/table{i}")
    for i, part in enumerate(parts):
        save(part, f"{path}/part{i}")
    about = json.dumps({"kind": kind, "values": values, "tables": list(tables), "parts": len(parts)})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Transformer:
    """The model that `save` wrote below `path`."""
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    kind, values = about["kind"], about["values"]
    if kind == "spark":
        if not values["module"].startswith("pyspark.ml."):
            raise ValueError(f"{values['module']} is no module of Spark's models")
        return getattr(importlib.import_module(values["module"]), values["name"]).load(f"{path}/model")
    parts = [load(spark, f"{path}/part{i}") for i in range(about["parts"])]
    if kind == "pipeline":
        return PipelineModel(parts)
    if kind not in _KINDS:
        raise ValueError(f"unknown kind of model {kind!r}")
    tables = {name: spark.read.parquet(f"{path}/table{i}") for i, name in enumerate(about["tables"])}
    return _KINDS[kind].restore(values, tables, parts)


class Bundle(Saved, Model):
    """Everything between raw rows and predictions: the fitted steps in order, the raw columns they need, and the classes' names.

    `transform` checks the columns, replays the steps and, where `labels` is
    given, adds `predicted_label`, the name of the predicted class (null if the
    prediction is null or out of range).
    """

    def __init__(self, steps: list[Transformer], columns: list[str], labels: list[str] | None = None):
        super().__init__()
        self.steps, self.columns, self.labels = list(steps), list(columns), labels

    def _transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing input columns: {', '.join(missing)}")
        for step in self.steps:
            df = step.transform(df)
        if self.labels is not None:
            names = F.array(*[F.lit(n) for n in self.labels])
            df = df.withColumn("predicted_label", F.get(names, F.col("prediction").cast("int")))
        return df

    def state(self):
        return {"columns": self.columns, "labels": self.labels}, {}, self.steps

    @classmethod
    def restore(cls, values, tables, parts):
        return cls(parts, values["columns"], values["labels"])
