"""Models fitted by data-parallel descent: kernel machines, linear machines of several losses, and a small network.

A step sums loss and gradient of each partition's rows where they are; the
partitions' sums, as long as the parameters, are added in groups before they
come to the driver, which keeps a limited memory of past steps to choose the
direction. Several step lengths are tried in one pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.persist import Saved, frozen

#: Steps remembered, step lengths tried at once, partitions whose sums are added together, and rows handled at once.
MEMORY, LENGTHS, GROUP, ROWS = 8, tuple(0.5**i for i in range(8)), 64, 4096
EPSILON = 0.1

#: loss(margins, targets) -> loss of each row and output, and its derivative by the margin. Targets are -1 and 1, or numbers.
LOSSES: dict[str, Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]] = {}


def _loss(f):
    LOSSES[f.__name__] = f
    return f


@_loss
def squared_hinge(m, y):
    gap = np.maximum(0.0, 1 - y * m)
    return gap**2, -2 * y * gap


@_loss
def modified_huber(m, y):
    z = y * m
    near = np.maximum(0.0, 1 - z)
    return np.where(z >= -1, near**2, -4 * z), np.where(z >= -1, -2 * y * near, -4 * y)


@_loss
def squared_insensitive(m, y):
    gap = np.maximum(0.0, np.abs(m - y) - EPSILON)
    return gap**2, 2 * np.sign(m - y) * gap


@_loss
def squared(m, y):
    return (m - y) ** 2, 2 * (m - y)


@dataclass
class Map:
    """Features of features: none, random waves of a Gaussian kernel, or all products of two (and the features)."""

    kind: str = "plain"
    waves: np.ndarray | None = None
    shift: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "waves":
            return np.cos(x @ self.waves.T + self.shift) * math.sqrt(2 / len(self.shift))
        if self.kind == "products":
            i, j = np.triu_indices(x.shape[1])
            return np.hstack([x, x[:, i] * x[:, j]])
        return x

    def width(self, n: int) -> int:
        return len(self.shift) if self.kind == "waves" else n + n * (n + 1) // 2 if self.kind == "products" else n


@dataclass
class Net:
    """Margins of mapped features, linear or through a hidden layer, from one vector of parameters."""

    map: Map
    inputs: int
    outputs: int
    hidden: int = 0
    center: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    @property
    def shapes(self) -> list[tuple[int, int]]:
        d = self.map.width(self.inputs)
        return [(d + 1, self.hidden), (self.hidden + 1, self.outputs)] if self.hidden else [(d + 1, self.outputs)]

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.normal(0, 1 / math.sqrt(a), (a, b)) if self.hidden else np.zeros((a, b))).ravel() for a, b in self.shapes])

    def parts(self, w: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append(w[at : at + a * b].reshape(a, b))
            at += a * b
        return out

    def ready(self, x: np.ndarray) -> np.ndarray:
        """Scaled and mapped features, missing ones as the mean, with a last column of ones."""
        z = self.map((np.where(np.isnan(x), self.center, x) - self.center) / self.scale)
        return np.hstack([z, np.ones((len(z), 1))])

    def margins(self, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        parts = self.parts(w)
        for p in parts[:-1]:
            z = np.hstack([np.tanh(z @ p), np.ones((len(z), 1))])
        return z @ parts[-1]

    def gradient(self, w: np.ndarray, z: np.ndarray, y: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
        """Sums over rows of the loss and its gradient."""
        parts = self.parts(w)
        if not self.hidden:
            value, by = LOSSES[loss](z @ parts[0], y)
            return float(value.sum()), (z.T @ by).ravel()
        h = np.tanh(z @ parts[0])
        one = np.hstack([h, np.ones((len(h), 1))])
        value, by = LOSSES[loss](one @ parts[1], y)
        inner = (by @ parts[1][:-1].T) * (1 - h * h)
        return float(value.sum()), np.concatenate([(z.T @ inner).ravel(), (one.T @ by).ravel()])

    def penalised(self) -> np.ndarray:
        """1 for weights, 0 for the constants."""
        return np.concatenate([np.vstack([np.ones((a - 1, b)), np.zeros((1, b))]).ravel() for a, b in self.shapes])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            x, y = (part[c].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in ("x", "y"))
            yield x, y


def _summed(table: DataFrame, size: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of f over all rows: by partition, then by groups of partitions, then on the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for x, y in _batches(batches):
            total += f(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "v"])

    def group(t: pa.Table) -> pa.Table:
        order = np.argsort(t["part"].to_numpy())
        rows = t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, size)[order]
        return pa.table({"part": pa.array([t["part"].to_numpy().min()], pa.int32()), "v": pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.float64()))})

    sums = table.mapInArrow(each, "part int, v array<double>")
    if table.rdd.getNumPartitions() > GROUP:
        sums = sums.groupBy(F.floor(F.col("part") / GROUP)).applyInArrow(lambda t: group(t), "part int, v array<double>")
    rows = sorted(sums.collect(), key=lambda r: r["part"])  # the order of addition is fixed
    return np.sum([r["v"] for r in rows], axis=0) if rows else np.zeros(size)


def minimise(table: DataFrame, net: Net, loss: str, n: int, l2: float, steps: int = 60, tolerance: float = 1e-5, seed: int = 42) -> np.ndarray:
    """Parameters that minimise mean loss + l2 / 2 |weights|^2 over the rows (x, y)."""
    free, w = net.penalised(), net.start(seed)

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        s = _summed(table, len(w) + 1, lambda x, y: (lambda v, g: np.append(g, v))(*net.gradient(w, net.ready(x), y, loss)))
        return s[-1] / n + l2 / 2 * float(free @ (w * w)), s[:-1] / n + l2 * free * w

    value, slope = at(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max(initial=0) < tolerance:
            break
        way, kept = -slope.copy(), []
        for s, y in reversed(past):
            kept.append(a := float(s @ way) / float(s @ y))
            way -= a * y
        if past:
            way *= float(past[-1][0] @ past[-1][1]) / float(past[-1][1] @ past[-1][1])
        else:
            way /= max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(past, reversed(kept), strict=True):
            way += s * (a - float(y @ way) / float(s @ y))
        descent = float(slope @ way)
        if descent >= 0:
            way, descent, past = -slope, -float(slope @ slope), []
        tried = [w + t * way for t in LENGTHS]
        sums = _summed(table, len(LENGTHS), lambda x, y: (lambda z: np.array([float(LOSSES[loss](net.margins(v, z), y)[0].sum()) for v in tried]))(net.ready(x)))  # noqa: B023
        values = [s / n + l2 / 2 * float(free @ (v * v)) for s, v in zip(sums, tried, strict=True)]
        good = [i for i, t in enumerate(LENGTHS) if values[i] <= value + 1e-4 * t * descent]
        if not good:
            if not past:
                break
            past = []
            continue
        new = tried[good[0]]
        fresh, now = at(new)
        if float((new - w) @ (now - slope)) > 1e-12:
            past = [*past, (new - w, now - slope)][-MEMORY:]
        done = value - fresh < tolerance * max(1e-12, abs(value)) * 0.1
        w, value, slope = new, fresh, now
        if done:
            break
    return w


class Descent(Estimator):
    """`fit` takes `features` and `label`. Classes are told apart one against the rest; with `calibrate`, their probabilities come from sigmoids fitted to the margins of rows that the machine did not see."""

    def __init__(self, task: str, loss: str, classes: int = 2, l2: float = 1e-3, map: str = "plain", gamma: float = 0.1, waves: int = 100, hidden: int = 0, calibrate: bool = True, steps: int = 60, seed: int = 42, folds: int = 3):
        super().__init__()
        if loss not in LOSSES or map not in ("plain", "waves", "products"):
            raise ValueError(f"losses are {', '.join(LOSSES)}; maps plain, waves and products")
        self.task, self.loss, self.l2, self.map, self.gamma, self.waves, self.hidden, self.calibrate, self.steps, self.seed, self.folds = task, loss, l2, map, gamma, waves, hidden, calibrate, steps, seed, folds
        self.outputs = classes if task == "multiclass" else 1

    def _fit(self, df: DataFrame) -> DescentModel:
        x, label = vector_to_array("features"), F.col("label").cast("double")
        first = df.select(F.size(x)).first()
        width = first[0] if first else 0
        clean = lambda i: F.when(~F.isnan(x[i]), x[i])
        about = df.agg(F.count("*"), F.coalesce(F.avg(label), F.lit(0.0)), F.coalesce(F.stddev_pop(label), F.lit(0.0)), F.array(*[F.coalesce(F.avg(clean(i)), F.lit(0.0)) for i in range(width)]), F.array(*[F.coalesce(F.stddev_pop(clean(i)), F.lit(0.0)) for i in range(width)])).first()
        n, mean, spread = about[0], about[1], about[2] or 1.0
        rng = np.random.default_rng(self.seed)
        made = Map(self.map, rng.normal(0, math.sqrt(2 * self.gamma), (self.waves, width)), rng.uniform(0, 2 * math.pi, self.waves)) if self.map == "waves" else Map(self.map)
        net = Net(made, width, self.outputs, self.hidden, np.array(about[3], float), np.array([s if s > 0 else 1.0 for s in about[4]], float))
        if self.task == "regression":
            y = F.array((label - mean) / spread)
        elif self.outputs == 1:
            y = F.array(2 * label - 1)
        else:
            y = F.array(*[F.when(label == c, 1.0).otherwise(-1.0) for c in range(self.outputs)])
        # a row's fold follows from what it holds, so equal rows stay together
        table = frozen(df.select(x.alias("x"), y.alias("y"), F.pmod(F.xxhash64(x, label), F.lit(self.folds)).cast("int").alias("fold"), label.alias("label")))
        w = minimise(table.select("x", "y"), net, self.loss, max(1, n), self.l2, self.steps, seed=self.seed)
        sigmoids = [(1.0, 0.0)] * self.outputs
        if self.task != "regression" and self.calibrate and n:
            parts = []
            for f in range(self.folds):
                seen = table.where(F.col("fold") != f)
                own = minimise(seen.select("x", "y"), net, self.loss, max(1, seen.count()), self.l2, self.steps, seed=self.seed)
                parts.append(table.where(F.col("fold") == f).withColumn("m", _margin_udf(net, own)("x")))
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            sigmoids = _sigmoids(frozen(whole.select("m", "y")), self.outputs)
        return DescentModel(self.task, net, w, sigmoids, mean if self.task == "regression" else 0.0, spread if self.task == "regression" else 1.0)


def _margin_udf(net: Net, w: np.ndarray):
    @F.pandas_udf("array<double>")
    def margins(batch: pd.Series) -> pd.Series:
        return pd.Series(list(net.margins(w, net.ready(np.stack(batch.to_numpy()).astype(float))))) if len(batch) else pd.Series([], dtype=object)

    return margins


def _sigmoids(rows: DataFrame, outputs: int, rounds: int = 30) -> list[tuple[float, float]]:
    """a and b of 1 / (1 + exp(-(a m + b))) for each output, by Newton steps; targets keep off 0 and 1 by the classes' sizes. One aggregation a step for all outputs."""
    counts = rows.agg(*[F.count_if(F.col("y")[k] > 0).alias(f"p{k}") for k in range(outputs)], F.count("*").alias("n")).first()
    at = [(1.0, 0.0)] * outputs
    for _ in range(rounds):
        exprs = []
        for k, (a, b) in enumerate(at):
            pos, neg = counts[f"p{k}"], counts["n"] - counts[f"p{k}"]
            m = F.col("m")[k]
            t = F.when(F.col("y")[k] > 0, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
            p = 1 / (1 + F.exp(-(a * m + b)))
            exprs += [F.sum((p - t) * m), F.sum(p - t), F.sum(p * (1 - p) * m * m), F.sum(p * (1 - p) * m), F.sum(p * (1 - p))]
        s = rows.agg(*[e.alias(f"e{i}") for i, e in enumerate(exprs)]).first()
        moved = 0.0
        for k, (a, b) in enumerate(at):
            ga, gb, haa, hab, hbb = (s[5 * k + i] or 0.0 for i in range(5))
            step = np.linalg.solve([[haa + 1e-9, hab], [hab, hbb + 1e-9]], [ga, gb])
            step *= min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
            at[k] = (a - float(step[0]), b - float(step[1]))
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-6:
            break
    return at


class DescentModel(Saved, Model):
    """prediction, and probability for classes."""

    def __init__(self, task: str, net: Net, w: np.ndarray, sigmoids: list, mean: float, spread: float):
        super().__init__()
        self.task, self.net, self.w, self.sigmoids, self.mean, self.spread = task, net, np.asarray(w), [tuple(s) for s in sigmoids], mean, spread

    def state(self):
        m = self.net.map
        net = {"inputs": self.net.inputs, "outputs": self.net.outputs, "hidden": self.net.hidden, "center": self.net.center.tolist(), "scale": self.net.scale.tolist()}
        mapped = {"kind": m.kind, "waves": None if m.waves is None else m.waves.tolist(), "shift": None if m.shift is None else m.shift.tolist()}
        return {"task": self.task, "net": net, "map": mapped, "w": self.w.tolist(), "sigmoids": self.sigmoids, "mean": self.mean, "spread": self.spread}, {}, []

    @classmethod
    def restore(cls, values, tables, parts):
        m, n = values["map"], values["net"]
        mapped = Map(m["kind"], *(None if m[c] is None else np.array(m[c]) for c in ("waves", "shift")))
        net = Net(mapped, n["inputs"], n["outputs"], n["hidden"], np.array(n["center"], float), np.array(n["scale"], float))
        return cls(values["task"], net, np.array(values["w"]), values["sigmoids"], values["mean"], values["spread"])

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_m", _margin_udf(self.net, self.w)(vector_to_array("features")))
        if self.task == "regression":
            return out.withColumn("prediction", F.col("_m")[0] * self.spread + self.mean).drop("_m")
        p = [1 / (1 + F.exp(-(a * F.col("_m")[k] + b))) for k, (a, b) in enumerate(self.sigmoids)]
        if self.net.outputs == 1:
            return out.withColumns({"prediction": (p[0] >= 0.5).cast("double"), "probability": array_to_vector(F.array(1 - p[0], p[0]))}).drop("_m")
        out = out.withColumn("_p", F.array(*p))
        share = F.transform("_p", lambda v: v / F.aggregate("_p", F.lit(0.0), lambda a, b: a + b))
        return out.withColumns({"prediction": (F.array_position("_p", F.array_max("_p")) - 1).cast("double"), "probability": array_to_vector(share)}).drop("_m", "_p")
