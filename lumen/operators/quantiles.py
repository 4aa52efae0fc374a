"""Exact percentiles of many columns in bounded memory.

A sketch of fixed size gives, for each percentile, two values that it lies
between; counting the rows below and up to them proves it, and what lies between
is narrowed in the same way until it is few rows or one value. Only those rows
are then grouped by value and ranked. So nothing but sketches, counts and a
bounded number of rows leaves a task, however many distinct values a column has,
and the result is that of sorting it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Size of a sketch; rows that a percentile's bracket may hold in the end; columns in one pass.
ACCURACY, FEW, COLUMNS = 5_000, 1_000_000, 32
#: How far in share of the rows a bracket reaches to either side: by a column's own sketch, and by that of a column it is a part of.
SLACK = 3 / ACCURACY
SLACKS = (SLACK, 2.5 * SLACK, 10 * SLACK, 40 * SLACK)


@dataclass
class _Bracket:
    """Where the values of rank `k` and the next lie: not below `lo` and not above `hi`."""

    column: str
    share: float
    n: int
    lo: float = -math.inf
    hi: float = math.nan  # above all others
    below: int = 0
    upto: int = 0

    def __post_init__(self):
        self.upto = self.n
        self.place = self.share * (self.n - 1)
        self.k, self.next = math.floor(self.place), math.ceil(self.place)

    @property
    def inside(self) -> Column:
        return (F.col(self.column) >= F.lit(self.lo)) & (F.col(self.column) <= F.lit(self.hi))

    @property
    def held(self) -> bool:
        return self.below <= self.k and self.next < self.upto

    @property
    def many(self) -> bool:
        return self.upto - self.below > FEW and self.lo != self.hi

    def around(self) -> tuple[float, float]:
        """Shares of the rows inside between which the sketch is sure to have both ranks."""
        rows = self.upto - self.below
        slack = 2 / ACCURACY + 1.5 / rows
        return max(0.0, (self.k - self.below) / rows - slack), min(1.0, (self.next + 1 - self.below) / rows + slack)


def _narrow(rows: DataFrame, brackets: list[_Bracket]) -> None:
    """Every bracket drawn closer, or left as it was where the counts do not prove the new one."""
    ends = rows.agg(*[F.percentile_approx(F.when(b.inside, F.col(b.column)), list(b.around()), ACCURACY).alias(str(i)) for i, b in enumerate(brackets)]).first()
    _prove(rows, brackets, [ends[i] for i in range(len(brackets))])


def _prove(rows: DataFrame, brackets: list[_Bracket], ends: list[list[float]]) -> None:
    old = [(b.lo, b.hi, b.below, b.upto) for b in brackets]
    for b, (lo, hi) in zip(brackets, ends, strict=True):
        b.lo, b.hi = lo, hi
    counts = rows.agg(*[e.alias(f"{n}{i}") for i, b in enumerate(brackets) for n, e in (("b", F.count_if(F.col(b.column) < F.lit(b.lo))), ("u", F.count_if(F.col(b.column) <= F.lit(b.hi))))]).first()
    for i, (b, before) in enumerate(zip(brackets, old, strict=True)):
        b.below, b.upto = counts[f"b{i}"], counts[f"u{i}"]
        if not b.held:
            b.lo, b.hi, b.below, b.upto = before


def _some(df: DataFrame, asked: dict[str, tuple[Column, list[float]]], like: dict[str, str]) -> dict[str, list[float] | None]:
    names = {c: f"x{i}" for i, c in enumerate(asked)}
    rows = df.select(*[x.cast("double").alias(names[c]) for c, (x, _) in asked.items()])
    # the first sketch of a column serves all its percentiles, and those of its parts, before its rows are counted
    by = {c: like[c] if like.get(c) in asked else c for c in asked}
    reach = lambda p, slack: (max(0.0, p - slack), min(1.0, p + slack))
    grid: dict[str, set[float]] = {}
    for c, (_, ps) in asked.items():
        grid.setdefault(by[c], set()).update(v for p in ps for slack in (SLACKS[:1] if by[c] == c else SLACKS) for v in reach(p, slack))
    counted = [F.count(a).alias(f"n{a}") for a in names.values()]
    first = rows.agg(*counted, *[F.percentile_approx(names[c], sorted(g), ACCURACY).alias(f"s{names[c]}") for c, g in grid.items()]).first()
    of = {c: [_Bracket(a, p, first[f"n{a}"]) for p in asked[c][1]] if first[f"n{a}"] else [] for c, a in names.items()}
    brackets, ends = [], []
    for c, mine in of.items():
        at = dict(zip(sorted(grid[by[c]]), first[f"s{names[by[c]]}"] or [], strict=False))
        for b in mine:
            # a part drawn at random is off by some deviations of its ranks
            need = SLACK + 4 * math.sqrt(b.share * (1 - b.share) / b.n) if by[c] != c else SLACK
            lo, hi = reach(b.share, next((v for v in SLACKS if v >= need), SLACKS[-1]))
            brackets.append(b)
            ends.append([at[lo], at[hi]])
    if not brackets:
        return dict.fromkeys(asked)
    _prove(rows, brackets, ends)
    size = None
    while (wide := [b for b in brackets if b.many]) and size != sum(b.upto - b.below for b in wide):
        size = sum(b.upto - b.below for b in wide)
        _narrow(rows, wide)
    found = _ranked(rows, brackets, {names[c]: names[v] for c, v in by.items()})
    out, i = {}, iter(range(len(brackets)))
    for c, mine in of.items():
        out[c] = [_between(b, *found[next(i)]) for b in mine] or None
    return out


def _ranked(rows: DataFrame, brackets: list[_Bracket], by: dict[str, str]) -> dict[int, tuple[float, float]]:
    """The values of rank k and the next of each bracket, from the rows inside. `by` names the column that holds all of a column's values."""
    order = lambda v: (math.isnan(v), v)
    # rows are looked at bracket by bracket only near one: within the hull of those of a percentile's parts
    hulls: dict[tuple[str, float], tuple[float, float]] = {}
    for b in brackets:
        lo, hi = hulls.get((by[b.column], b.share), (b.lo, b.hi))
        hulls[by[b.column], b.share] = (min(lo, b.lo, key=order), max(hi, b.hi, key=order))
    near = rows.where(reduce(lambda a, b: a | b, [(F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi)) for (c, _), (lo, hi) in hulls.items()]))
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(rows.columns.index(b.column)).alias("c"), F.lit(b.lo).alias("lo"), F.lit(b.hi).alias("hi")) for i, b in enumerate(brackets)])
    near = near.select(F.array(*rows.columns).alias("x")).withColumn("e", F.explode(F.filter(ends, lambda e: (F.col("x")[e["c"]] >= e["lo"]) & (F.col("x")[e["c"]] <= e["hi"]))))
    near = near.select("e.i", F.col("x")[F.col("e.c")].alias("v"))
    counts = near.groupBy("i", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    k, after = (F.element_at(F.array(*[F.lit(v - b.below).cast("long") for v, b in zip(at, brackets, strict=True)]), F.col("i") + 1) for at in ([b.k for b in brackets], [b.next for b in brackets]))
    ranked = counts.withColumn("u", upto).where((F.col("u") > k) & (F.col("u") - F.col("n") <= after))
    out: dict[int, list[tuple[int, float]]] = {}
    for r in ranked.collect():  # the values of two ranks a bracket
        out.setdefault(r["i"], []).append(r["v"])
    # rank k's value is the least of them, the next one's the greatest
    return {i: (min(v, key=order), max(v, key=order)) for i, v in out.items()}


def _between(b: _Bracket, low: float, high: float) -> float:
    if b.k == b.next or low == high:
        return low
    return (b.next - b.place) * low + (b.place - b.k) * high


def quantiles(df: DataFrame, asked: dict[str, tuple[Column, list[float]]], like: dict[str, str] | None = None) -> dict[str, list[float] | None]:
    """For each name the percentiles (shares from 0 to 1, linearly interpolated) of its expression; None without values. Nulls are left out; NaN is above all numbers.

    `df` is read three times, and once or twice more for each narrowing beyond
    that: one brings a bracket from n rows to about n / 800. `like` may name, for
    an expression over a part of the rows, the one over all of them, whose sketch
    then serves both; counts prove what it gives, so it changes no result.
    """
    names, out = list(asked), {}
    for i in range(0, len(names), COLUMNS):
        out |= _some(df, {c: asked[c] for c in names[i : i + COLUMNS]}, like or {})
    return out
