"""The feature language: declared specs, learned once, replayed on any batch.

Specs are compiled, not interpreted: `fit` learns every scalar parameter in one
aggregation and every keyed table in one group-by a key column, written once;
`transform` is one broadcast-or-shuffle lookup a key column and one select.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import clip, double, finite, is_numeric, quantile, ratio
from ..functions.persist import Saved, frozen
from .quantiles import quantiles

AGGREGATES = ("mean", "median", "std", "max", "min")
#: Patterns that date texts may follow, tried in this order.
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd MMM yyyy", "MMM d, yyyy", "yyyyMMdd")
#: Learned tables up to this many keys are broadcast.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class FeatureSpec:
    """One operation and its parameters."""

    op: str
    params: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: FeatureSpec | dict) -> FeatureSpec:
        return raw if isinstance(raw, cls) else cls(raw["op"], dict(raw.get("params", {})))

    def to_dict(self) -> dict:
        return {"op": self.op, "params": dict(self.params)}


@dataclass(frozen=True)
class Op:
    columns: tuple[str, ...]  # parameters that name a column
    options: dict[str, Any]  # other parameters and their defaults
    outputs: Any  # params -> output names
    needs_target: bool = False
    check: Any = None  # params -> problem or None


def _check_bins(p: dict) -> str | None:
    n = p["n_bins"]
    return None if isinstance(n, int) and not isinstance(n, bool) and n >= 2 else "n_bins must be an integer of at least 2"


def _check_smoothing(p: dict) -> str | None:
    s = p["smoothing"]
    ok = isinstance(s, (int, float)) and not isinstance(s, bool) and math.isfinite(s) and s >= 0
    return None if ok else "smoothing must be finite and not negative"


def _check_group(p: dict) -> str | None:
    if p["agg"] not in AGGREGATES:
        return f"agg must be one of {', '.join(AGGREGATES)}"
    return "by and col must differ" if p["by"] == p["col"] else None



OPS: dict[str, Op] = {
    "log1p": Op(("col",), {}, lambda p: [f"{p['col']}_log1p"]),
    "ratio": Op(("a", "b"), {}, lambda p: [f"{p['a']}_ratio_{p['b']}"]),
    "product": Op(("a", "b"), {}, lambda p: [f"{p['a']}_x_{p['b']}"]),
    "datetime_parts": Op(("col",), {}, lambda p: [f"{p['col']}_{x}" for x in ("dayofweek", "month", "is_weekend")]),
    "winsorize": Op(("col",), {}, lambda p: [f"{p['col']}_winsor"]),
    "quantile_bin": Op(("col",), {"n_bins": 4}, lambda p: [f"{p['col']}_bin{p['n_bins']}"], check=_check_bins),
    "frequency_encode": Op(("col",), {}, lambda p: [f"{p['col']}_freq"]),
    "target_encode": Op(("col",), {"smoothing": 10.0}, lambda p: [f"{p['col']}_target_enc"], True, _check_smoothing),
    "group_aggregate": Op(("by", "col"), {"agg": "mean"}, lambda p: [f"{p['col']}_{p['agg']}_by_{p['by']}"], check=_check_group),
}


def full_params(spec: FeatureSpec) -> dict:
    return OPS[spec.op].options | spec.params


def output_names(spec: FeatureSpec) -> list[str]:
    return OPS[spec.op].outputs(full_params(spec))


def validate_specs(specs: list, columns: list[str]) -> list[str]:
    """Problems of a list of specs against a table's columns; none if empty. Never raises."""
    problems, made = [], {}
    for i, raw in enumerate(specs):
        try:
            spec = FeatureSpec.of(raw)
        except Exception:  # noqa: BLE001 - anything may be passed here
            problems.append(f"spec {i}: not an operation with parameters")
            continue
        op = OPS.get(spec.op) if isinstance(spec.op, str) else None
        if op is None:
            problems.append(f"spec {i}: unknown operation {spec.op!r}")
            continue
        allowed = {*op.columns, *op.options}
        problems += [f"spec {i} ({spec.op}): missing parameter {p!r}" for p in op.columns if p not in spec.params]
        problems += [f"spec {i} ({spec.op}): unexpected parameter {p!r}" for p in spec.params if p not in allowed]
        if any(p not in spec.params for p in op.columns):
            continue
        bad = [p for p in op.columns if not isinstance(spec.params[p], str)]
        if bad:
            problems += [f"spec {i} ({spec.op}): {p} must name a column" for p in bad]
            continue
        problems += [f"spec {i} ({spec.op}): no column {spec.params[p]!r}" for p in op.columns if spec.params[p] not in columns]
        params = full_params(spec)
        if op.check and (why := op.check(params)):
            problems.append(f"spec {i} ({spec.op}): {why}")
            continue
        for name in op.outputs(params):
            if name in columns:
                problems.append(f"spec {i} ({spec.op}): output {name!r} is a column already")
            if name in made:
                problems.append(f"spec {i} ({spec.op}): output {name!r} is made by spec {made[name]} already")
            made.setdefault(name, i)
    return problems


def triage(specs: list, columns: list[str]) -> tuple[list[FeatureSpec], list[tuple[Any, list[str]]]]:
    """Usable specs, and the others with their problems."""
    good: list[FeatureSpec] = []
    bad = []
    for raw in specs:
        before = len(validate_specs(good, columns))
        why = validate_specs([*good, raw], columns)
        if len(why) > before:
            bad.append((raw, why[before:]))
        else:
            good.append(FeatureSpec.of(raw))
    return good, bad


def propose(types: dict[str, str], distinct: dict[str, int], task: str) -> list[FeatureSpec]:
    """Specs for a profiled table: `types` by column, `distinct` value counts, `task` regression, binary or multiclass."""
    numeric = [c for c, t in types.items() if t == "NUMERICAL"]
    out = [FeatureSpec("log1p", {"col": c}) for c in numeric]
    out += [FeatureSpec("datetime_parts", {"col": c}) for c, t in types.items() if t == "DATETIME"]
    if len(numeric) >= 2:
        out += [FeatureSpec("product", {"a": numeric[0], "b": numeric[1]}), FeatureSpec("ratio", {"a": numeric[0], "b": numeric[1]})]
    categories = [c for c, t in types.items() if t == "CATEGORICAL"]
    out += [FeatureSpec("frequency_encode", {"col": c}) for c in categories if distinct.get(c, 0) >= 3]
    if task in ("regression", "binary"):
        out += [FeatureSpec("target_encode", {"col": c, "smoothing": 10.0}) for c in categories]
    return out


def _number(df: DataFrame, c: str) -> Column:
    if not is_numeric(df, c) and not isinstance(df.schema[c].dataType, T.BooleanType):
        raise ValueError(f"column {c!r} must be numeric, not {df.schema[c].dataType.simpleString()}")
    return double(c)


def _key(c: str) -> Column:
    return F.col(c).cast("string")


def _moment(df: DataFrame, c: str, pattern: str | None) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(c)
    if not isinstance(kind, T.StringType):
        raise ValueError(f"column {c!r} must be a date, a time or text, not {kind.simpleString()}")
    if pattern is None:
        return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(p)) for p in DATE_PATTERNS])
    return F.try_to_timestamp(F.col(c), F.lit(pattern))


_GROUPED = {"mean": F.avg, "median": lambda x: quantile(x, 0.5), "std": F.stddev_samp, "max": F.max, "min": F.min}


class FeatureTransformer(Estimator):
    """Learns the parameters of specs from training rows; `fit` gives a FeatureModel."""

    def __init__(self, specs: list, target: str | None = None):
        super().__init__()
        self.specs = [FeatureSpec.of(s) for s in specs]
        self.target = target

    def _fit(self, df: DataFrame) -> FeatureModel:
        problems = validate_specs(self.specs, df.columns)
        if problems:
            raise ValueError("; ".join(problems))
        y = finite(_number(df, self.target)) if self.target else None
        scalars: dict[str, Column] = {"_rows": F.count("*")}
        ranked: dict[str, tuple[Column, list[float]]] = {}
        tables: dict[str, dict[str, Column]] = {}
        for i, spec in enumerate(self.specs):
            p = full_params(spec)
            if spec.op == "winsorize":
                ranked[f"v{i}"] = (finite(_number(df, p["col"])), [0.01, 0.99])
            elif spec.op == "quantile_bin":
                x = finite(_number(df, p["col"]))
                ranked[f"v{i}"] = (x, [k / p["n_bins"] for k in range(1, p["n_bins"])])
                scalars[f"lo{i}"], scalars[f"hi{i}"] = F.min(x), F.max(x)
            elif spec.op == "datetime_parts":
                scalars[f"any{i}"] = F.count(_moment(df, p["col"], None))
                if isinstance(df.schema[p["col"]].dataType, T.StringType):
                    for j, pattern in enumerate(DATE_PATTERNS):
                        scalars[f"p{i}_{j}"] = F.count(_moment(df, p["col"], pattern))
            elif spec.op == "frequency_encode":
                tables.setdefault(p["col"], {})[f"t{i}"] = F.count("*")
            elif spec.op == "target_encode":
                if y is None:
                    raise ValueError("target_encode needs a target")
                scalars[f"v{i}"] = F.avg(y)
                tables.setdefault(p["col"], {}).update({f"t{i}_n": F.count(y), f"t{i}_m": F.avg(y)})
            elif spec.op == "group_aggregate":
                x = finite(_number(df, p["col"]))
                if p["agg"] == "median":
                    ranked[f"v{i}"] = (x, [0.5])
                else:
                    scalars[f"v{i}"] = _GROUPED[p["agg"]](x)
                tables.setdefault(p["by"], {})[f"t{i}"] = _GROUPED[p["agg"]](x)
            else:
                for c in OPS[spec.op].columns:
                    _number(df, p[c])
        got = df.agg(*[e.alias(a) for a, e in scalars.items()]).first().asDict()
        medians = {f"v{i}" for i, spec in enumerate(self.specs) if spec.op == "group_aggregate"}
        got |= {a: v[0] if v and a in medians else v for a, v in quantiles(df, ranked).items()}
        self._check(got)
        learned = {}
        for by, exprs in tables.items():
            table = df.where(F.col(by).isNotNull()).groupBy(_key(by).alias("_k")).agg(*[e.alias(a) for a, e in exprs.items()])
            cols: list[Column] = []
            for i, spec in enumerate(self.specs):
                p = full_params(spec)
                if spec.op == "frequency_encode" and p["col"] == by:
                    cols.append((F.col(f"t{i}") / F.lit(float(got["_rows"]))).alias(f"t{i}"))
                elif spec.op == "target_encode" and p["col"] == by:
                    s, g = float(p["smoothing"]), float(got[f"v{i}"])
                    cols.append(F.when(F.col(f"t{i}_n") + s > 0, (F.coalesce(F.col(f"t{i}_n") * F.col(f"t{i}_m"), F.lit(0.0)) + s * g) / (F.col(f"t{i}_n") + s)).otherwise(F.lit(g)).alias(f"t{i}"))
                elif spec.op == "group_aggregate" and p["by"] == by:
                    cols.append(double(f"t{i}").alias(f"t{i}"))
            learned[by] = frozen(table.select("_k", *cols))
        return FeatureModel(self.specs, got, learned)

    def _check(self, got: dict) -> None:
        for i, spec in enumerate(self.specs):
            p = full_params(spec)
            if spec.op in ("winsorize", "quantile_bin") and got[f"v{i}"] is None:
                raise ValueError(f"{spec.op}: column {p['col']!r} has no finite value")
            if spec.op == "quantile_bin":
                edges = got[f"v{i}"]
                if sum(e <= got[f"lo{i}"] for e in set(edges)) == sum(e <= got[f"hi{i}"] for e in set(edges)):
                    raise ValueError(f"quantile_bin: all rows of {p['col']!r} fall in one bin")
            if spec.op == "datetime_parts" and not got[f"any{i}"]:
                raise ValueError(f"datetime_parts: no value of {p['col']!r} is a date")
            if spec.op in ("target_encode", "group_aggregate") and got[f"v{i}"] is None:
                raise ValueError(f"{spec.op}: no finite value to learn from")


class FeatureModel(Saved, Model):
    """Appends the outputs of learned specs to any batch; a row's outputs depend on that row alone, never on the training data as it is later."""

    def __init__(self, specs: list[FeatureSpec], scalars: dict, tables: dict[str, DataFrame]):
        super().__init__()
        self.specs, self.scalars, self.tables = specs, scalars, tables
        self._small: dict[str, bool] = {}

    @property
    def required_columns(self) -> list[str]:
        return list(dict.fromkeys(full_params(s)[c] for s in self.specs for c in OPS[s.op].columns))

    @property
    def output_columns(self) -> list[str]:
        return [n for s in self.specs for n in output_names(s)]

    def learned_parameters(self) -> dict:
        """Scalars by output name; keyed tables stay tables."""
        return {output_names(s)[0]: self.scalars[f"v{i}"] for i, s in enumerate(self.specs) if f"v{i}" in self.scalars}

    def state(self):
        return {"specs": [s.to_dict() for s in self.specs], "scalars": self.scalars}, self.tables, []

    @classmethod
    def restore(cls, values, tables, parts):
        return cls([FeatureSpec.of(s) for s in values["specs"]], values["scalars"], tables)

    def _bounded(self, by: str) -> bool:
        """Whether a learned table has few enough keys to broadcast; counted once."""
        if by not in self._small:
            self._small[by] = self.tables[by].limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        return self._small[by]

    def _transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.required_columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        clash = [c for c in self.output_columns if c in df.columns]
        if clash:
            raise ValueError(f"columns exist already: {', '.join(clash)}")
        out, kept = df, df.columns
        for j, (by, table) in enumerate(self.tables.items()):
            side = table.select(F.col("_k").alias(f"_k{j}"), *[F.col(c).alias(f"_{c}") for c in table.columns if c != "_k"], F.lit(True).alias(f"_hit{j}"))
            out = out.join(F.broadcast(side) if self._bounded(by) else side, _key(by) == F.col(f"_k{j}"), "left")
        at = {by: j for j, by in enumerate(self.tables)}
        columns: list[Column] = []
        for i, spec in enumerate(self.specs):
            p, names = full_params(spec), output_names(spec)
            got = self._expressions(out, i, spec, p, at)
            columns += [finite(e.cast("double")).alias(n) for n, e in zip(names, got, strict=True)]
        return out.select(*[F.col(f"`{c}`") for c in kept], *columns)

    def _expressions(self, df: DataFrame, i: int, spec: FeatureSpec, p: dict, at: dict[str, int]) -> list[Column]:
        def looked_up(by: str, fallback: float) -> Column:
            # a key that was seen may hold null, which is not the fallback
            return F.when(F.col(by).isNotNull(), F.when(F.col(f"_hit{at[by]}"), F.col(f"_t{i}")).otherwise(F.lit(float(fallback))))

        if spec.op == "log1p":
            return [F.log1p(clip(finite(_number(df, p["col"])), 0.0, None))]
        if spec.op == "ratio":
            return [ratio(finite(_number(df, p["a"])), finite(_number(df, p["b"])))]
        if spec.op == "product":
            return [_number(df, p["a"]) * _number(df, p["b"])]
        if spec.op == "datetime_parts":
            pattern = None
            if isinstance(df.schema[p["col"]].dataType, T.StringType):
                total = self.scalars.get(f"any{i}", 0)
                pattern = next((q for j, q in enumerate(DATE_PATTERNS) if total and self.scalars.get(f"p{i}_{j}") == total), None)
            m = _moment(df, p["col"], pattern)
            return [F.weekday(m), F.month(m), F.when(m.isNotNull(), (F.weekday(m) >= 5).cast("double"))]
        if spec.op == "winsorize":
            lo, hi = self.scalars[f"v{i}"]
            x = _number(df, p["col"])
            return [clip(F.when(~F.isnan(x), x), lo, hi)]
        if spec.op == "quantile_bin":
            x = _number(df, p["col"])
            edges = sorted(set(self.scalars[f"v{i}"]))
            bins = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
            return [F.when(x.isNotNull() & ~F.isnan(x), bins)]
        if spec.op == "frequency_encode":
            return [looked_up(p["col"], 0.0)]
        if spec.op == "target_encode":
            return [looked_up(p["col"], self.scalars[f"v{i}"])]
        return [looked_up(p["by"], self.scalars[f"v{i}"])]
