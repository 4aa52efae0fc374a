"""Mutual information of numbers and a class by nearest neighbours, without sorting a column in one task.

For a row of value x, d is the distance to its k-th neighbour of the same class
and m the number of rows nearer than d, itself included; the estimate is
psi(N) + mean psi(k) - mean psi(rows of the class) - mean psi(m), at least 0.
Rows are first counted by (column, value, class), which takes care of ties, and
the counts dealt by range. A part gets the k nearest values of each class beyond
its borders from a table of every part's first and last ones; what a row's
reach covers outside its part is asked of the parts that hold its two ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import double
from ..functions.persist import frozen

#: Neighbours; distinct values of a part, and the most parts, which bounds what comes to the driver.
K, PART_ROWS, MOST_PARTS = 3, 200_000, 20_000
BROADCAST_CLASSES = 100_000


def digamma(x: np.ndarray) -> np.ndarray:
    """psi of positive numbers: moved up to 10 and more, then by its asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (low := x < 10).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def kth_distance(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each of the sorted values to the k-th nearest of the others."""
    n = len(x)
    best = np.full(n, np.inf)
    at = np.arange(n)
    for left in range(k + 1):
        a, b = at - left, at + (k - left)
        ok = (a >= 0) & (b < n)
        reach = np.maximum(x[at[ok]] - x[a[ok]], x[b[ok]] - x[at[ok]])
        best[ok] = np.minimum(best[ok], reach)
    return best


ENDS = "feature int, y string, part int, low array<double>, high array<double>"
ASK = "kind string, feature int, part int, row long, n long, right boolean, target int, value double, psi double"


def _ends(k: int):
    """The first and last k values of each column and class of a part."""

    def run(t: pa.Table) -> pa.Table:
        part, rows = t["part"][0].as_py(), {}
        for f, y, x, n in sorted(zip(*(t[c].to_pylist() for c in ("feature", "y", "x", "n")), strict=True), key=lambda r: (r[0], r[1], r[2])):
            rows.setdefault((f, y), []).extend([x] * min(n, k))
        made = [(f, y, part, v[:k], v[-k:]) for (f, y), v in rows.items()]
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=["feature", "y", "part", "low", "high"])

    return run


def _carried(k: int):
    """For each part, the last k values of the parts before it and the first k of those after, of a column and class."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in ("part", "low", "high")), strict=True), key=lambda r: r[0])
        before, after, now = [], [], []
        for _, _, high in rows:
            before.append(now)
            now = (now + high)[-k:]
        now = []
        for _, low, _ in reversed(rows):
            after.append(now)
            now = (low + now)[:k]
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        cols = ([t["feature"][0].as_py()] * len(rows), [t["y"][0].as_py()] * len(rows), [r[0] for r in rows], before, after[::-1])
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["feature", "y", "part", "low", "high"])

    return run


class Places:
    """First value and rows before each part of a column: a row a part and column."""

    def __init__(self, rows: list):
        self.parts, self.first, self.before, self.total = {}, {}, {}, {}
        for r in sorted(rows, key=lambda r: (r["feature"], r["part"])):
            f = r["feature"]
            self.parts.setdefault(f, []).append(r["part"])
            self.first.setdefault(f, []).append(r["first"])
            self.before.setdefault(f, []).append(self.total.get(f, 0))
            self.total[f] = self.total.get(f, 0) + r["n"]

    def holding(self, f: int, v: np.ndarray) -> np.ndarray:
        """The index of the part in which a value's rank is found."""
        return np.maximum(np.searchsorted(self.first[f], v, side="right") - 1, 0)


def _reach(places: Places, k: int):
    """Each row's reach; sums where it ends within the part, questions where it does not."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        part, out = left["part"][0].as_py(), []
        f, x, n, size = (left[c].to_numpy() for c in ("feature", "x", "n", "size"))
        y = np.array(left["y"].to_pylist(), object)
        carried = {(a, b): (lo, hi) for a, b, lo, hi in zip(*(right[f"_{c}"].to_pylist() for c in ("feature", "y", "low", "high")), strict=True)}
        number = 0
        for feature in np.unique(f):
            mine = np.flatnonzero(f == feature)
            reach, used = np.zeros(len(mine)), np.zeros(len(mine))
            for label in set(y[mine]):
                own = np.flatnonzero(y[mine] == label)
                own = own[np.argsort(x[mine[own]])]
                rows = mine[own]
                kk = int(min(k, size[rows[0]] - 1))
                before, after = carried[int(feature), label]
                times = np.minimum(n[rows], kk + 1)
                values = np.concatenate([before, np.repeat(x[rows], times), after])
                d = kth_distance(values, kk)
                reach[own], used[own] = d[len(before) + np.cumsum(times) - times], kk
            order = np.argsort(x[mine], kind="stable")
            values, upto = x[mine][order], np.concatenate([[0], np.cumsum(n[mine][order])])
            lo, hi = x[mine] - reach, x[mine] + reach
            at = places.parts[int(feature)].index(part)
            still = reach == 0
            home = (places.holding(int(feature), lo) == at) & (places.holding(int(feature), hi) == at) | still
            m = np.where(still, upto[np.searchsorted(values, x[mine], "right")] - upto[np.searchsorted(values, x[mine], "left")], upto[np.searchsorted(values, hi, "left")] - upto[np.searchsorted(values, lo, "right")])
            w = n[mine]
            psi = float(w @ (digamma(used) - digamma(size[mine])) - w[home] @ digamma(m[home]))
            out.append(("sum", int(feature), part, 0, int(w.sum()), None, None, None, psi))
            for i in np.flatnonzero(~home):
                for side, v in ((False, lo[i]), (True, hi[i])):
                    target = places.parts[int(feature)][int(places.holding(int(feature), np.array([v]))[0])]
                    out.append(("ask", int(feature), part, number + int(i), int(w[i]), side, target, float(v), None))
            number += len(mine)
        return _asked(out)

    return run


def _asked(rows: list) -> pa.Table:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.float64(), pa.float64())
    names = ["kind", "feature", "part", "row", "n", "right", "target", "value", "psi"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def _ranks(places: Places):
    """How many rows of the column lie below a value on the right, or not above one on the left."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"feature": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "row": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "rank": pa.array([], pa.int64())})
        part = asked["target"][0].as_py()
        f, x, n = (rows[f"_{c}"].to_numpy() for c in ("feature", "x", "n"))
        q, v, right = (asked[c].to_numpy(zero_copy_only=False) for c in ("feature", "value", "right"))
        rank = np.zeros(len(q), np.int64)
        for feature in np.unique(q):
            mine = np.flatnonzero(f == feature)
            mine = mine[np.argsort(x[mine])]
            upto = np.concatenate([[0], np.cumsum(n[mine])]) + places.before[int(feature)][places.parts[int(feature)].index(part)]
            for side in (False, True):
                these = np.flatnonzero((q == feature) & (right == side))
                rank[these] = upto[np.searchsorted(x[mine], v[these], "left" if side else "right")] * (1 if side else -1)
        return pa.table({"feature": asked["feature"], "part": asked["part"], "row": asked["row"], "n": asked["n"], "rank": pa.array(rank)})

    return run


def _psi(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["feature"], pa.array(-b["n"].to_numpy() * digamma(b["m"].to_numpy()))], names=["feature", "psi"])


def neighbour_information(df: DataFrame, features: list[str], target: str, k: int = K) -> DataFrame:
    """feature, mi (nats) of numeric columns and a class. Rows without value or class, and classes of one row, take no part; a column without rows has 0."""
    spark = df.sparkSession
    x = [F.struct(F.lit(i).alias("feature"), double(c).alias("x")) for i, c in enumerate(features)]
    rows = df.where(F.col(target).isNotNull()).select(F.explode(F.array(*x)).alias("r"), F.col(target).cast("string").alias("y")).select("r.*", "y").where("x is not null and not isnan(x)")
    cells = frozen(rows.groupBy("feature", "x", "y").agg(F.count("*").alias("n")))
    sizes = cells.groupBy("feature", "y").agg(F.sum("n").alias("size")).where("size > 1")
    count, classes = cells.count(), sizes.count()
    names = spark.createDataFrame(list(enumerate(features)), "feature int, name string")
    if not classes:
        return names.select(F.col("name").alias("feature"), F.lit(0.0).alias("mi"))
    parts = max(1, min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // PART_ROWS)))
    # without this bound the sizes meet the cells by shuffle
    kept = cells.join(F.broadcast(sizes) if classes <= BROADCAST_CLASSES else sizes, ["feature", "y"])
    dealt = frozen(kept.repartitionByRange(parts, "feature", "x").withColumn("part", F.spark_partition_id()))
    places = Places(dealt.groupBy("feature", "part").agg(F.min("x").alias("first"), F.sum("n").alias("n")).collect())
    carried = dealt.groupBy("part").applyInArrow(_ends(k), ENDS).groupBy("feature", "y").applyInArrow(_carried(k), ENDS)
    found = frozen(dealt.groupBy("part").cogroup(carried.select(*[F.col(c).alias(f"_{c}") for c in carried.columns]).groupBy("_part")).applyInArrow(_reach(places, k), ASK))
    asked = found.where("kind = 'ask'").select(*[F.col(c).alias(c) for c in ("feature", "part", "row", "n", "right", "target", "value")])
    own = dealt.select(*[F.col(c).alias(f"_{c}") for c in ("part", "feature", "x", "n")])
    ranks = asked.groupBy("target").cogroup(own.groupBy("_part")).applyInArrow(_ranks(places), "feature int, part int, row long, n long, rank long")
    far = ranks.groupBy("feature", "part", "row").agg(F.sum("rank").alias("m"), F.first("n").alias("n")).select("feature", "n", "m").mapInArrow(_psi, "feature int, psi double")
    total = found.where("kind = 'sum'").select("feature", "n", "psi").unionByName(far.select("feature", F.lit(0).cast("long").alias("n"), "psi"))
    sums = total.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("psi").alias("psi"))
    psi_n = spark.createDataFrame([(f, float(digamma(np.array([float(n)]))[0])) for f, n in places.total.items()], "feature int, psi_n double")
    mi = sums.join(F.broadcast(psi_n), "feature").select("feature", F.greatest(F.lit(0.0), F.col("psi_n") + F.col("psi") / F.col("n")).alias("mi"))
    return names.join(mi, "feature", "left").select(F.col("name").alias("feature"), F.coalesce("mi", F.lit(0.0)).alias("mi"))
