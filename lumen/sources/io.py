"""Tables in and out."""

from __future__ import annotations

import difflib
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import persist


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read csv, parquet or json (by suffix unless named) with NaN as null."""
    fmt = fmt or next((f for f in ("csv", "parquet", "json") if path.rstrip("/").lower().endswith(f".{f}")), None)
    if fmt == "csv":
        df = spark.read.csv(path, header=True, inferSchema=True)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        df = spark.read.json(path, multiLine=True)
    else:
        raise ValueError(f"unsupported file type: {path!r} (csv, parquet and json are read)")
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def from_rows(spark: SparkSession, rows: dict | list[dict], schema: str | T.StructType) -> DataFrame:
    """One mapping or a list of them as a table of a declared schema."""
    rows = [rows] if isinstance(rows, dict) else rows
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return nan_to_null(spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema))


def check_target(df: DataFrame, target: str) -> None:
    """Raise with the nearest column names if the target is missing."""
    if target not in df.columns:
        near = difflib.get_close_matches(target, df.columns, n=3)
        raise ValueError(f"no column {target!r}; " + (f"did you mean {', '.join(near)}?" if near else f"columns: {', '.join(df.columns[:20])}"))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing input columns: {', '.join(missing)}")


def write_baseline(df: DataFrame, path: str, target: str | None = None) -> None:
    """Training features without the target, for later drift checks."""
    (df.drop(target) if target else df).write.mode("overwrite").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def score_batch(spark: SparkSession, source: str, model, sink: str, columns: list[str], fmt: str = "csv") -> DataFrame:
    """Read, check the input columns, transform, write; returns what was written. `model` is one, or the folder of a saved one."""
    model = persist.load(spark, model) if isinstance(model, str) else model
    df = load(spark, source)
    require_columns(df, columns)
    out = model.transform(df)
    flat = out.select(*[c for c, kind in out.dtypes if kind not in ("vector",) and not kind.startswith(("array", "struct", "map", "udt"))])
    writer = flat.write.mode("overwrite")
    writer.option("header", True).csv(sink) if fmt == "csv" else writer.format(fmt).save(sink)
    return flat


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_artifact(path: str, content: dict | list) -> None:
    """A JSON report, in any store that Spark can write to; reports hold aggregates only. Numbers that JSON has no form for become null."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return None if isinstance(x, float) and not math.isfinite(x) else x

    spark = SparkSession.active()
    fs, target = _file(spark, path)
    fs.mkdirs(target.getParent())
    out = fs.create(target, True)
    try:
        out.write(bytearray(json.dumps(plain(content), indent=2, default=str, sort_keys=True).encode()))
    finally:
        out.close()


def read_artifact(path: str) -> dict | list:
    """What `write_artifact` wrote."""
    spark = SparkSession.active()
    fs, target = _file(spark, path)
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def append_metrics(spark: SparkSession, path: str, run_id: str, metric: str, scores: dict[str, tuple[float, float]]) -> None:
    """Add a row a model (score, latency in ms) to the table of runs below `path`."""
    rows = [(run_id, model, metric, float(score), float(ms)) for model, (score, ms) in scores.items()]
    made = spark.createDataFrame(rows, "run_id string, model string, metric string, score double, latency_ms double")
    made.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
