"""Connected components over an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, hot, lookup

MAX_ROUNDS = 64


def _hubs(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    return hot(rows.groupBy(key).agg(F.count("*").alias("n")), [key], total)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v); root is the least node of its component.

    Alternates large-star and small-star steps: each node's neighbours are
    hooked to the least of them, first the larger ones, then the smaller ones.
    Rows never exceed the edges; a group is reduced to its minimum before
    anything is joined back, the rows of a node with very many neighbours stay
    where they are in that join, and every round is written to the shared
    folder. Null nodes and self-loops are ignored. An empty table gives no rows.
    The result reads a written table: `forget` it when done.
    """
    now = cut(edges.select("u", "v").where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(now)
    for _ in range(MAX_ROUNDS):
        # rows are (larger, smaller); what is larger than v is hooked to the least of v and its smaller neighbours
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        large = lookup(now.withColumnRenamed("v", "k"), low.withColumnRenamed("u", "k"), ["k"], _hubs(now.withColumnRenamed("v", "k"), "k", was[0]), "left")
        large = cut(large.select("u", F.coalesce("m", "k").alias("v")).distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = lookup(large, low, ["u"], _hubs(large, "u", was[0]))
        new = cut(joined.select("v", "m").where("v <> m").union(joined.select("u", "m")).toDF("u", "v").distinct(), "cc")
        forget(now, large)
        now, then = new, was
        was = mark(now)
        if was == then:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct().toDF("node", "root"))
    out._lumen_path = now._lumen_path
    return out
