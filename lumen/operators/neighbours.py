"""Exact nearest neighbours: blocks around pivots, of which most are proven too far to look at.

Features are scaled by their deviation. Training rows, equal ones counted once,
are dealt to the nearest of some pivot rows, and large cells split. A block is
its pivot and the greatest distance from it, so |q - pivot| - radius bounds the
distance of all its rows from below and |q - pivot| + radius from above. A
query looks through the block of its nearest pivot first; the k-th distance
found there, or the distance within which enough rows lie for certain, decides
which other blocks could hold something nearer, and only those are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.persist import Saved, frozen

#: Rows of a block, the most pivots, which bounds what comes to the driver, and queries that meet a block at once.
BLOCK, MOST_PIVOTS, QUERIES = 2048, 4096, 4096
#: A class has at most so many values.
CLASSES = 1000


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """|x - p| of every row and point, by differences, so that equal distances come out equal."""
    out = np.empty((len(x), len(points)))
    for j, p in enumerate(points):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


class NearestNeighbours(Estimator):
    """Votes of the k nearest training rows; rows at equal distance go by label, smaller first."""

    def __init__(self, task: str, k: int):
        super().__init__()
        self.task, self.k = task, k

    def _fit(self, df: DataFrame) -> NeighboursModel:
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
        first = rows.select(F.size("x")).first()
        width = first[0] if first else 0
        clean = lambda i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])
        about = rows.agg(F.array(*[F.coalesce(F.avg(clean(i)), F.lit(0.0)) for i in range(width)]), F.array(*[F.coalesce(F.stddev_pop(clean(i)), F.lit(0.0)) for i in range(width)])).first()
        center, scale = [list(v) for v in about]
        scale = [s if s > 0 else 1.0 for s in scale]
        labels = []
        if self.task != "regression":
            labels = [r[0] for r in rows.select("y").distinct().orderBy("y").limit(CLASSES + 1).collect()]
            if len(labels) > CLASSES:
                raise ValueError(f"more than {CLASSES} classes")
        points = frozen(rows.groupBy("x", "y").agg(F.count("*").alias("n")).select(scaled(F.col("x"), center, scale).alias("x"), "y", "n"))
        count = points.count()
        pivots = np.array([r["x"] for r in points.orderBy(F.xxhash64("x"), "x", "y").limit(max(1, min(MOST_PIVOTS, count // BLOCK))).select("x").distinct().collect()])
        size = max(BLOCK, count // MOST_PIVOTS)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = _distances(_matrix(b["x"]), pivots)
                    at = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b["x"], b["y"], b["n"], pa.array(d[np.arange(len(at)), at])], names=["cell", "x", "y", "n", "far"])

        dealt = points.mapInArrow(deal, "cell int, x array<double>, y double, n long, far double")
        if count:
            dealt = frozen(dealt)
            parts = dealt.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("parts"))
            dealt = dealt.join(F.broadcast(parts), "cell").withColumn("block", F.concat_ws("-", "cell", F.pmod(F.xxhash64("x", "y"), F.col("parts"))))  # a row a pivot
        blocks = [tuple(r) for r in dealt.groupBy("block", "cell").agg(F.max("far"), F.sum("n")).orderBy("block").collect()] if count else []
        index = {b[0]: i for i, b in enumerate(blocks)}
        table = df.sparkSession.createDataFrame(list(index.items()), "block string, place int") if blocks else None
        data = frozen(dealt.join(F.broadcast(table), "block").select("place", "x", "y", "n")) if blocks else None
        return NeighboursModel(self.task, self.k, center, scale, labels, [pivots[b[1]].tolist() for b in blocks], [float(b[2]) for b in blocks], [int(b[3]) for b in blocks], data)


def scaled(x: Column, center: list[float], scale: list[float]) -> Column:
    """Features less their mean by their deviation; a missing one counts as the mean."""
    parts = F.arrays_zip(x.alias("v"), F.array(*map(F.lit, center)).alias("m"), F.array(*map(F.lit, scale)).alias("s"))
    return F.transform(parts, lambda p: F.when(F.isnan(p["v"]), F.lit(0.0)).otherwise((p["v"] - p["m"]) / p["s"]))


FOUND = "q long, distance double, y double, n long"


class NeighboursModel(Saved, Model):
    """prediction and, for classes, probability; the training table stays distributed."""

    def __init__(self, task, k, center, scale, labels, pivots, radius, counts, data: DataFrame | None):
        super().__init__()
        self.task, self.k, self.center, self.scale, self.labels, self.pivots, self.radius, self.counts, self.data = task, k, center, scale, labels, pivots, radius, counts, data

    def state(self):
        names = ("task", "k", "center", "scale", "labels", "pivots", "radius", "counts")
        return {n: getattr(self, n) for n in names}, {"data": self.data} if self.data is not None else {}, []

    @classmethod
    def restore(cls, values, tables, parts):
        return cls(**values, data=tables.get("data"))

    def _asked(self, queries: DataFrame, first: bool) -> DataFrame:
        """Blocks to look at: (q, x, place, bound). First the one of the nearest pivot, then all others that the k-th distance so far (`within`) leaves open."""
        pivots, radius, counts, k = np.array(self.pivots), np.array(self.radius), np.array(self.counts), self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d = _distances(_matrix(b["x"]), pivots)
                order = np.argsort(d + radius, axis=1, kind="stable")
                enough = np.minimum((np.cumsum(counts[order], axis=1) < k).sum(axis=1), len(counts) - 1)
                rows = np.arange(len(d))
                bound = np.where(counts.sum() >= k, (d + radius)[rows, order[rows, enough]], np.inf)
                home = d.argmin(axis=1)
                if first:
                    pick = np.zeros(d.shape, bool)
                    pick[rows, home] = True
                else:
                    bound = np.minimum(bound, b["within"].to_numpy(zero_copy_only=False))
                    # rounding may put a row just beyond its bound
                    pick = (d - radius) * (1 - 1e-12) - 1e-12 <= bound[:, None]
                    pick[rows, home] = False
                i, j = np.nonzero(pick)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([b["q"].take(at), b["x"].take(at), pa.array(j.astype(np.int32)), pa.array(bound[i])], names=["q", "x", "place", "bound"])

        return queries.mapInArrow(run, "q long, x array<double>, place int, bound double")

    def _looked(self, asked: DataFrame) -> DataFrame:
        """The k nearest rows of each asked block, as (q, distance, y, n). A block that many queries ask meets them in chunks."""
        k = self.k

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows: list[list] = [[], [], [], []]
            if left.num_rows and right.num_rows:
                x, y, n = _matrix(right["_x"].combine_chunks()), right["_y"].to_numpy(), right["_n"].to_numpy()
                for q, p in zip(left["q"].to_pylist(), _matrix(left["x"].combine_chunks()), strict=True):
                    d = np.sqrt(((x - p) ** 2).sum(axis=1))
                    near = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                    near = near[np.lexsort((y[near], d[near]))][:k]
                    for values, new in zip(rows, ([q] * len(near), d[near].tolist(), y[near].tolist(), n[near].tolist()), strict=True):
                        values.extend(new)
            return pa.table([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["q", "distance", "y", "n"])

        chunks = asked.groupBy("place").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))  # a row a block
        left = asked.join(F.broadcast(chunks), "place").withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")))
        right = self.data.select(F.col("place").alias("_place"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("n").alias("_n"))
        right = right.join(F.broadcast(chunks.withColumnRenamed("place", "_place")), "_place").withColumn("_chunk", F.explode(F.expr("sequence(0L, chunks - 1L)"))).drop("chunks")
        return left.groupBy("place", "chunk").cogroup(right.groupBy("_place", "_chunk")).applyInArrow(run, FOUND)

    def neighbours(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(q, distance, y, n): the k nearest rows of each query (q, x: scaled), equal ones as one with their number; and the pairs of query and block looked at and there were, as one row."""
        first = frozen(self._asked(queries, True))
        home = frozen(self._looked(first))
        w = Window.partitionBy("q").orderBy("distance", "y")
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        within = home.withColumn("_n", F.sum("n").over(upto)).groupBy("q").agg(F.coalesce(F.min(F.when(F.col("_n") >= self.k, F.col("distance"))), F.lit(float("inf"))).alias("within"))
        then = frozen(self._asked(queries.join(within, "q").select("q", "x", "within"), False))
        both = home.unionByName(self._looked(then)).withColumn("_n", F.sum("n").over(upto))
        taken = both.withColumn("n", F.least("n", self.k - F.col("_n") + F.col("n"))).where("n > 0").drop("_n")
        pairs = first.agg(F.count("*").alias("a")).join(then.agg(F.count("*").alias("b"))).select((F.col("a") + F.col("b")).alias("looked_at"), (F.col("a") * len(self.pivots)).alias("pairs"))
        return taken, pairs

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.data is None:
            return df.withColumn("prediction", F.lit(None).cast("double"))
        keyed = frozen(df.withColumn("_q", F.monotonically_increasing_id()))
        top, _ = self.neighbours(keyed.select(F.col("_q").alias("q"), scaled(vector_to_array("features"), self.center, self.scale).alias("x")))
        top = top.withColumnRenamed("q", "_q")
        if self.task == "regression":
            vote = top.groupBy("_q").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("prediction"))
            return keyed.join(vote, "_q").drop("_q")
        share = [F.sum(F.when(F.col("y") == label, F.col("n")).otherwise(0)) / F.sum("n") for label in self.labels]
        vote = top.groupBy("_q").agg(F.array(*share).alias("_p"))
        best = F.element_at(F.array(*[F.lit(float(v)) for v in self.labels]), F.array_position("_p", F.array_max("_p")).cast("int"))
        return keyed.join(vote, "_q").withColumn("prediction", best).withColumn("probability", array_to_vector("_p")).drop("_q", "_p")

