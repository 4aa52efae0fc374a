"""Drift of a stream: the population stability of each window against a saved baseline.

The baseline is cells and shares, small and fixed, so a window's state is one
count a cell. The same code runs over a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import double, is_numeric
from ..operators.drift import BINS, DRIFTED, FLOOR
from ..sources.io import read_artifact, write_artifact

#: A categorical column has at most so many categories.
CATEGORIES = 1000


@dataclass
class Baseline:
    """By column its edges (numbers) or categories, and the share of the rows in each cell."""

    edges: dict[str, list[float]]
    categories: dict[str, list[str]]
    shares: dict[str, list[float]]

    @classmethod
    def of(cls, df: DataFrame, columns: list[str], bins: int = BINS) -> Baseline:
        """Equal-width bins of a number's range, the categories of other columns. A number without width has no cells, and so no drift."""
        numeric = [c for c in columns if is_numeric(df, c)]
        edges: dict[str, list[float]] = {}
        if numeric:
            ends = df.agg(*[e for i, c in enumerate(numeric) for e in (F.min(double(c)).alias(f"lo{i}"), F.max(double(c)).alias(f"hi{i}"))]).first()
            for i, c in enumerate(numeric):
                lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
                edges[c] = [lo - 1e-6, *[lo + (hi - lo) / bins * k for k in range(1, bins)], hi + 1e-6] if lo is not None and hi > lo else []
        categories = {}
        for c in columns:
            if c not in numeric:
                found = [r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().limit(CATEGORIES + 1).collect()]
                if len(found) > CATEGORIES:
                    raise ValueError(f"{c!r} has more than {CATEGORIES} categories")
                categories[c] = sorted(found)
        made = cls(edges, categories, {})
        sums = df.agg(*made.counts()).first()
        for c in columns:
            n = sums[f"{c}:n"]
            made.shares[c] = [v / n if n else 0.0 for v in sums[f"{c}:cells"]]
        return made

    def counts(self) -> list[Column]:
        """Aggregates for each column: `<c>:n`, its values, and `<c>:cells`, those in each cell. Numbers beyond the range and new categories are in none."""
        out = []
        for c, e in self.edges.items():
            x = double(c)
            last = len(e) - 2
            cells = [F.count_if((x >= e[k]) & (x <= e[k + 1] if k == last else x < e[k + 1])) for k in range(len(e) - 1)]
            out += [F.count(x).alias(f"{c}:n"), (F.array(*cells) if cells else F.array().cast("array<long>")).alias(f"{c}:cells")]
        for c, names in self.categories.items():
            v = F.col(c).cast("string")
            cells = [F.count_if(v == name) for name in names]
            out += [F.count(v).alias(f"{c}:n"), (F.array(*cells) if cells else F.array().cast("array<long>")).alias(f"{c}:cells")]
        return out

    def save(self, path: str) -> None:
        write_artifact(path, {"edges": self.edges, "categories": self.categories, "shares": self.shares})

    @classmethod
    def load(cls, path: str) -> Baseline:
        return cls(**read_artifact(path))


def _stability(expected: list[float], n: Column, cells: Column) -> Column:
    """The index from a window's counts: shares floored and renormalised on both sides; 0 without values or cells."""
    if not expected:
        return F.lit(0.0)
    e = [max(v, FLOOR) for v in expected]
    known = F.array(*[F.lit(v / sum(e)) for v in e])
    add = lambda x, y: x + y
    shares = F.transform(cells, lambda c: F.greatest(c.cast("double") / n, F.lit(FLOOR)))
    # the total is taken once, not once a cell
    once = F.transform(F.array(F.struct(shares.alias("a"), F.aggregate(shares, F.lit(0.0), add).alias("t"))), lambda s: F.aggregate(F.zip_with(s["a"], known, lambda x, v: (x / s["t"] - v) * F.log(x / s["t"] / v)), F.lit(0.0), add))
    return F.when(n > 0, once[0]).otherwise(F.lit(0.0))


def drift_windows(events: DataFrame, at: str, baseline: Baseline, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, column, n, psi, drifted for each window and column of the baseline.

    Over a stream, windows come out once the watermark, `late` behind the latest
    event, has passed them; later rows are dropped. Rows without time are in no
    window. A window's state is a count a cell.
    """
    rows = events.withWatermark(at, late) if events.isStreaming else events
    sums = rows.where(F.col(at).isNotNull()).groupBy(F.window(at, length).alias("w")).agg(*baseline.counts())
    names = [*baseline.edges, *baseline.categories]
    each = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}:n`").alias("n"), _stability(baseline.shares[c], F.col(f"`{c}:n`"), F.col(f"`{c}:cells`")).alias("psi")) for c in names]
    return sums.select(F.col("w.start").alias("start"), F.inline(F.array(*each))).withColumn("drifted", F.col("psi") > DRIFTED)
