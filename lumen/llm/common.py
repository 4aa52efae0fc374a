"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of documents kept out of every fit: crc32(doc_id as text) mod FOLDS = 0.
FOLDS = 5
#: A key is hot if it has more than HOT_ROWS rows and more than one row in HOT_KEYS; so there are fewer than HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1000, 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod FOLDS; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from; a null id is not held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is configured (single machine only)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "lumen-checkpoints")
        os.makedirs(path, exist_ok=True)
        path = f"file://{path}"
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that later steps neither recompute it nor depend on a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumen_path = path
    for held in _WITHIN:
        held.append(out)
    return out


#: Tables written within `leaving_nothing`, one list for each that is open.
_WITHIN: list[list[DataFrame]] = []


@contextlib.contextmanager
def leaving_nothing():
    """Delete, at the end, all tables written within but the last one, which is the result."""
    held: list[DataFrame] = []
    _WITHIN.append(held)
    try:
        yield
    finally:
        _WITHIN.remove(held)
        forget(*held[:-1])


def forget(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_lumen_path", None)
        if path is not None:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def hot(counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame | None:
    """The hot keys in a table of keys and their row counts, out of `total` rows; fewer than HOT_KEYS, and none (None) where there are few rows."""
    if total <= HOT_ROWS:
        return None
    return counts.where(F.col(n) > max(HOT_ROWS, total // HOT_KEYS)).select(*keys)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """`rows` joined (inner or left) to `table`, which has one row a key.

    The rows of the keys in `heavy`, which `hot` keeps few, meet their rows of
    `table` by broadcast and stay where they are; the others are shuffled.
    """
    found = heavy.select(*keys).distinct().collect() if heavy is not None else []
    if not found:
        return rows.join(table, keys, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(found, rows.select(*keys).schema))
    cold = rows.join(few, keys, "left_anti").join(table, keys, how)
    return cold.unionByName(rows.join(few, keys, "left_semi").join(F.broadcast(table.join(few, keys, "left_semi")), keys, how))


#: Bits of a sieve: so many a key, and so many at most.
SIEVE_KEY_BITS, SIEVE_BITS = 16, 1 << 25


def sieve(keys: DataFrame, mark: Column, other: Column) -> tuple[DataFrame, Column]:
    """(bits, caught): a broadcast row of bits, and the condition on another table joined to it that its `other` may be the `mark` of a row of `keys`.

    True wherever it is one, and for few others; beyond SIEVE_BITS / SIEVE_KEY_BITS
    keys for more of them. Both hashes are 64 bits.
    """
    n = 64
    while n < min(SIEVE_BITS, SIEVE_KEY_BITS * keys.count()):
        n *= 2
    at = lambda h: F.pmod(h, F.lit(n))
    word, bit = lambda h: F.shiftright(at(h), 6).cast("int"), lambda h: (at(h) % 64).cast("int")
    found = keys.select(word(mark).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(mark)).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    words = [0] * (n // 64)
    for r in found:
        words[r["w"]] = r["b"]
    bits = F.broadcast(keys.sparkSession.createDataFrame([(words,)], "_sieve array<long>"))
    return bits, F.call_function("shiftright", F.get("_sieve", word(other)), bit(other)) % 2 != 0


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns named c0, c1, ..., and the new name of each (of the first, where one occurs twice), so that no name of the caller's meets one of an operator's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now: it does so once the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()
