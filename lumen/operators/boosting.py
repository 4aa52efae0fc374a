"""Newton boosting on histograms of gradients.

Features are binned once; a row is then one byte a feature, its label and its
margins. For every level of a tree each partition sums first and second
derivatives of the loss by node, feature and bin where its rows are, one
shuffle adds the partitions' sums up, and the split of greatest gain of each
node comes to the driver: rows never move, and what moves is bounded by nodes,
features and bins. Margins are written anew every REFRESH rounds; between them
the few trees since then are applied on the way.

Growth is by level, by leaf (the tree of all levels, cut back to the `leaves`
leaves that the greatest gains open first), or the same split for all nodes of
a level. Missing values go to the side that gains more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.persist import Saved, frozen
from .trees import Ensemble, Tree

#: The bin of missing values; the others are 0 to 254.
MISSING = 255
#: Rounds between two writings of the margins.
REFRESH = 8


@dataclass(frozen=True)
class Growth:
    """How trees are grown: `by` level, leaf or same (one split a level)."""

    by: str = "level"
    rounds: int = 20
    rate: float = 0.1
    depth: int = 4
    leaves: int = 31
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    least_hessian: float = 1.0
    least_rows: int = 1
    bins: int = 64
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42


@dataclass
class Nodes:
    """A tree while it grows; splits are by bin."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    sums: list[tuple[float, float, float]] = field(default_factory=lambda: [(0.0, 0.0, 0.0)])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float, left: tuple, right: tuple) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node], self.missing_left[node], self.gain[node] = feature, cut, a, a + 1, missing_left, gain
        for s in (left, right):
            self.feature.append(-1), self.cut.append(0), self.left.append(-1), self.right.append(-1), self.missing_left.append(False), self.sums.append(s), self.gain.append(0.0)
        return a, a + 1

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left, right, miss = (np.array(x) for x in (self.feature, self.cut, self.left, self.right, self.missing_left))
        at = np.zeros(len(codes), np.int64)
        while len(rows := np.flatnonzero(feature[at] >= 0)):
            n = at[rows]
            c = codes[rows, feature[n]]
            at[rows] = np.where(np.where(c == MISSING, miss[n], c <= cut[n]), left[n], right[n])
        return at

    def keep_best(self, leaves: int) -> None:
        """Undo all splits but those that open `leaves` leaves, greatest gain first."""
        open_, kept = [0] if self.feature[0] >= 0 else [], set()
        while open_ and len(kept) + 1 < leaves:
            n = max(open_, key=lambda i: (self.gain[i], -i))
            open_.remove(n)
            kept.add(n)
            open_ += [c for c in (self.left[n], self.right[n]) if self.feature[c] >= 0]
        for n in range(len(self.feature)):
            if n not in kept:
                self.feature[n] = -1

    def weight(self, node: int, g: Growth) -> float:
        s, h, _ = self.sums[node]
        return -np.sign(s) * max(abs(s) - g.l1, 0.0) / (h + g.l2) if h + g.l2 > 0 else 0.0

    def tree(self, edges: list[list[float]], g: Growth, output: int) -> Tree:
        inner = np.array(self.feature) >= 0
        threshold = np.array([edges[f][c] if f >= 0 else np.nan for f, c in zip(self.feature, self.cut, strict=True)])
        return Tree(np.array(self.feature), threshold, np.array(self.left), np.array(self.right), np.array([0.0 if i else self.weight(n, g) for n, i in enumerate(inner)]), np.array([s[2] for s in self.sums]), g.rate, output, {}, np.array(self.missing_left))


def derivatives(task: str, margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by each margin."""
    if task == "regression":
        return margins - label[:, None], np.ones_like(margins)
    if task == "binary":
        p = 1 / (1 + np.exp(-margins))
        return p - label[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (label[:, None] == np.arange(margins.shape[1])), np.maximum(p * (1 - p), 1e-16)


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each row's id, the same on every pass."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


def edges_of(df: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Cut points of each feature: all its values but the greatest where few occur, else quantiles of bounded error."""
    grid = [i / (4 * bins) for i in range(4 * bins)]
    x = F.col("x")
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(x[i]), x[i]), grid, 10_000).alias(str(i)) for i in range(width)]).first()
    out = []
    for i in range(width):
        have = sorted(set(found[i] or []))
        out.append(have if len(have) < bins else sorted(set((found[i])[4 * k] for k in range(1, bins))))
    return out


def _codes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _margins(column: pa.Array, outputs: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, outputs).copy()


def _apply(margins: np.ndarray, codes: np.ndarray, since: list[tuple[int, Nodes]], g: Growth) -> None:
    for k, n in since:
        margins[:, k] += g.rate * np.array([n.weight(i, g) for i in range(len(n.feature))])[n.place(codes)]


CELL = "k int, node int, feature int, bin int, g double, h double, n double"


def _histogram(task: str, since: list, now: list[Nodes], active: list[tuple[int, int]], columns: list[int], width: int, g: Growth, salt: int):
    """Sums of derivatives by active node, feature and bin, of a partition."""
    outputs, at = len(now), {kn: i for i, kn in enumerate(active)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(active), len(columns), MISSING + 1, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, label, ids = _codes(batch["code"], width), batch["label"].to_numpy(), batch["row"].to_numpy()
            margins = _margins(batch["margins"], outputs)
            _apply(margins, codes, since, g)
            first, second = derivatives(task, margins, label)
            taken = _uniform(ids, salt) < g.row_share if g.row_share < 1 else np.ones(len(ids), bool)
            for k, tree in enumerate(now):
                where = np.full(len(tree.feature), -1)
                for (o, node), i in at.items():
                    if o == k:
                        where[node] = i
                place = where[tree.place(codes)]
                rows = np.flatnonzero((place >= 0) & taken)
                for j, f in enumerate(columns):
                    cell = place[rows] * (MISSING + 1) + codes[rows, f]
                    for s, w in enumerate((first[rows, k], second[rows, k], None)):
                        total[:, j, :, s] += np.bincount(cell, w, minlength=len(active) * (MISSING + 1)).reshape(len(active), -1)
        i, j, b = np.nonzero(total[..., 2])
        keys = [np.array([active[x][0] for x in i], np.int32), np.array([active[x][1] for x in i], np.int32), np.array([columns[x] for x in j], np.int32), b.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*keys, *(total[i, j, b, s] for s in range(3)))], names=["k", "node", "feature", "bin", "g", "h", "n"])

    return run


def _gained(s: Column, h: Column, g: Growth) -> Column:
    t = F.greatest(F.abs(s) - g.l1, F.lit(0.0))
    return F.try_divide(t * t, h + g.l2)


def candidates(cells: DataFrame, g: Growth) -> DataFrame:
    """k, node, feature, bin, missing_left, gain and the sums on the left and in all: every split with its gain, from the summed cells (`CELL`).

    gain is half of T(G_L)^2/(H_L + l2) + T(G_R)^2/(H_R + l2) - T(G)^2/(H + l2), less
    gamma, where T takes l1 off the absolute sum. Splits that leave too little on a
    side have a null gain.
    """
    one = Window.partitionBy("k", "node", "feature")
    gone = F.col("bin") == MISSING
    upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"{c}_all": F.sum(c).over(one) for c in "ghn"} | {f"{c}_miss": F.sum(F.when(gone, F.col(c)).otherwise(0.0)).over(one) for c in "ghn"} | {f"{c}_upto": F.sum(F.when(gone, 0.0).otherwise(F.col(c))).over(upto) for c in "ghn"}
    rows = cells.withColumns(sums).where(~gone).withColumn("missing_left", F.explode(F.when(F.col("n_miss") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    rows = rows.withColumns({f"{c}_left": F.col(f"{c}_upto") + F.when(F.col("missing_left"), F.col(f"{c}_miss")).otherwise(0.0) for c in "ghn"})
    left = [F.col(f"{c}_left") for c in "ghn"]
    right = [F.col(f"{c}_all") - F.col(f"{c}_left") for c in "ghn"]
    enough = (F.least(left[2], right[2]) >= g.least_rows) & (F.least(left[1], right[1]) >= g.least_hessian)
    gain = (_gained(left[0], left[1], g) + _gained(right[0], right[1], g) - _gained(F.col("g_all"), F.col("h_all"), g)) / 2 - g.gamma
    return rows.select("k", "node", "feature", "bin", "missing_left", F.when(enough, gain).alias("gain"), *[F.col(f"{c}_{p}") for p in ("left", "all") for c in "ghn"])


def _filled(cells: DataFrame, active: list[tuple[int, int]], columns: list[int], edges: list[list[float]]) -> DataFrame:
    """`cells` with the empty ones too, so that all nodes have the same cuts."""
    spark = cells.sparkSession
    nodes = F.broadcast(spark.createDataFrame(active, "k int, node int"))
    bins = spark.createDataFrame([(f, len(edges[f])) for f in columns], "feature int, m int").select("feature", F.explode(F.concat(F.sequence(F.lit(0), F.col("m")), F.array(F.lit(MISSING)))).alias("bin"))
    return bins.join(nodes).join(cells, ["k", "node", "feature", "bin"], "left").na.fill(0.0, ["g", "h", "n"])


class NewtonBoosting(Estimator):
    """`fit` takes `features` (a vector) and `label` (a number, or 0, 1, ... for classes)."""

    def __init__(self, task: str, growth: Growth, classes: int = 2):
        super().__init__()
        if growth.bins > MISSING or growth.by not in ("level", "leaf", "same"):
            raise ValueError(f"at most {MISSING} bins, and growth by level, leaf or same")
        self.task, self.growth, self.outputs = task, growth, classes if task == "multiclass" else 1

    def _start(self, df: DataFrame) -> list[float]:
        if self.task == "multiclass":
            n = {int(r["label"]): r["count"] for r in df.groupBy("label").count().collect()}
            return [float(np.log(max(n.get(c, 0), 0.5) / max(1, sum(n.values())))) for c in range(self.outputs)]
        mean = df.agg(F.avg("label")).first()[0] or 0.0
        return [float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6)))) if self.task == "binary" else float(mean)]

    def _fit(self, df: DataFrame) -> BoostedModel:
        g, k = self.growth, self.outputs
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        first = rows.select(F.size("x")).first()
        width, start = first[0] if first else 0, self._start(rows)
        edges = edges_of(rows, width, g.bins) if width else []

        def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                codes = np.empty(x.shape, np.uint8)
                for f, e in enumerate(edges):
                    codes[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(e, x[:, f], side="left"))
                margins = pa.array(np.tile(start, (batch.num_rows, 1)).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in codes], pa.binary()), batch["label"], margins], names=["code", "label", "margins"])

        table = rows.mapInArrow(bin_, "code binary, label double, margins array<double>")
        table = frozen(table.withColumn("row", F.monotonically_increasing_id())) if width else table
        done: list[tuple[int, Nodes]] = []
        since: list[tuple[int, Nodes]] = []
        rng = np.random.default_rng(g.seed)
        for r in range(g.rounds if width else 0):
            columns = sorted(rng.choice(width, max(1, round(width * g.column_share)), replace=False).tolist()) if g.column_share < 1 else list(range(width))
            grown = self._grow(table, since, edges, columns, width, r)
            if all(n.feature[0] < 0 for n in grown):
                break
            since += list(enumerate(grown))
            done += list(enumerate(grown))
            if (r + 1) % REFRESH == 0 and r + 1 < g.rounds:
                table, since = self._refresh(table, since, width), []
        return BoostedModel(self.task, Ensemble([n.tree(edges, g, o) for o, n in done], start))

    def _refresh(self, table: DataFrame, since: list, width: int) -> DataFrame:
        g, outputs = self.growth, self.outputs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    margins = _margins(batch["margins"], outputs)
                    _apply(margins, _codes(batch["code"], width), since, g)
                    yield pa.RecordBatch.from_arrays([batch["code"], batch["label"], pa.array(margins.tolist(), pa.list_(pa.float64())), batch["row"]], names=["code", "label", "margins", "row"])

        return frozen(table.mapInArrow(run, "code binary, label double, margins array<double>, row long"))

    def _grow(self, table: DataFrame, since: list, edges: list, columns: list[int], width: int, salt: int) -> list[Nodes]:
        g = self.growth
        now = [Nodes() for _ in range(self.outputs)]
        active = [(o, 0) for o in range(self.outputs)]
        for _ in range(g.depth):
            cells = table.mapInArrow(_histogram(self.task, since, now, active, columns, width, g, salt + g.seed * 1000), CELL)
            cells = cells.repartition("k", "node", "feature").groupBy("k", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
            splits = candidates(_filled(cells, active, columns, edges) if g.by == "same" else cells, g)
            if g.by == "same":
                level = splits.groupBy("k", "feature", "bin", "missing_left").agg(F.sum(F.coalesce("gain", F.lit(0.0))).alias("_level"))
                best = level.groupBy("k").agg(F.max(F.struct("_level", (-F.col("feature")).alias("_f"), (-F.col("bin")).alias("_b"), (~F.col("missing_left")).alias("_r"))).alias("_best"))
                best = best.where("_best._level > 0").select("k", (-F.col("_best._f")).alias("feature"), (-F.col("_best._b")).alias("bin"), (~F.col("_best._r")).alias("missing_left"))
                splits = splits.join(F.broadcast(best), ["k", "feature", "bin", "missing_left"]).withColumn("gain", F.greatest("gain", F.lit(1e-300)))
            order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("m"), *[F.col(f"{c}_{p}") for p in ("left", "all") for c in "ghn"])
            found = splits.groupBy("k", "node").agg(F.max(order).alias("s")).select("k", "node", "s.*").collect()  # a row a node
            active = []
            for s in sorted(found, key=lambda x: (x["k"], x["node"])):
                tree, whole = now[s["k"]], tuple(s[f"{c}_all"] for c in "ghn")
                if s["node"] == 0:
                    tree.sums[0] = whole
                if s["gain"] is None or s["gain"] <= 0:
                    continue
                left = tuple(s[f"{c}_left"] for c in "ghn")
                active += [(s["k"], c) for c in tree.split(s["node"], -s["f"], -s["b"], not s["m"], s["gain"], left, tuple(a - b for a, b in zip(whole, left, strict=True)))]
            if not active:
                break
        if g.by == "leaf":
            for tree in now:
                tree.keep_best(g.leaves)
        return now


class BoostedModel(Saved, Model):
    """prediction, and probability for classes."""

    def __init__(self, task: str, made: Ensemble):
        super().__init__()
        self.task, self.made = task, made

    def ensemble(self) -> Ensemble:
        return self.made

    def state(self):
        return {"task": self.task, "start": self.made.start, "trees": [t.state() for t in self.made.trees]}, {}, []

    @classmethod
    def restore(cls, values, tables, parts):
        return cls(values["task"], Ensemble([Tree.of(t) for t in values["trees"]], values["start"]))

    def _transform(self, df: DataFrame) -> DataFrame:
        made, task = self.made, self.task

        @F.pandas_udf("array<double>")
        def margins(batch: pd.Series) -> pd.Series:
            return pd.Series(list(made.outputs(np.stack(batch.to_numpy()).astype(float)))) if len(batch) else pd.Series([], dtype=object)

        out = df.withColumn("_m", margins(vector_to_array("features")))
        if task == "regression":
            return out.withColumn("prediction", F.col("_m")[0]).drop("_m")
        if task == "binary":
            p = 1 / (1 + F.exp(-F.col("_m")[0]))
            return out.withColumns({"prediction": (F.col("_m")[0] > 0).cast("double"), "probability": array_to_vector(F.array(1 - p, p))}).drop("_m")
        e = F.transform("_m", lambda v: F.exp(v - F.array_max("_m")))
        out = out.withColumn("_e", e).withColumn("_p", F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
        return out.withColumns({"prediction": (F.array_position("_p", F.array_max("_p")) - 1).cast("double"), "probability": array_to_vector("_p")}).drop("_m", "_e", "_p")
