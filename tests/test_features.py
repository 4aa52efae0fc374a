"""Hand-computed parameters, and what must hold for every operation."""

from __future__ import annotations

import math

import pytest

from lumen.operators.features import OPS, FeatureSpec, FeatureTransformer, triage, validate_specs

SCHEMA = "id int, amount double, qty double, city string, dept string, ts string, y double"
#: Harvests of fields: weights with a gap, a debt and a spike; sorts and farms with gaps and one farm of a single row.
TRAIN = [(i, {4: None, 9: -3.25, 20: 8800.0}.get(i, round(11.5 + i * i % 29 / 4, 2)), float(i % 3), ["rye", "oats", None, "barley", "rye"][i % 5], "hill" if i == 17 else ["north", "south", "west"][i % 3], f"2019-{i % 12 + 1:02d}-{i % 27 + 1:02d}", (i * 5 % 13) / 2) for i in range(60)]
SERVE = [(0, 64000.0, 7.5, "millet", "delta", "2030-11-30", 0.0), (1, None, 0.0, None, None, None, 0.5), (2, -777.5, None, "oats", "hill", "soon", 1.0), (3, 14.25, 2.0, "rye", "west", "2019-06-16", 1.5)]
SPECS = {
    "log1p": {"col": "amount"}, "ratio": {"a": "amount", "b": "qty"}, "product": {"a": "amount", "b": "qty"}, "datetime_parts": {"col": "ts"}, "winsorize": {"col": "amount"},
    "quantile_bin": {"col": "amount", "n_bins": 4}, "frequency_encode": {"col": "city"}, "target_encode": {"col": "city"}, "group_aggregate": {"by": "dept", "col": "amount", "agg": "std"},
}


def values(df, *cols):
    return [tuple(r) for r in df.orderBy("id").select(*cols).collect()]


def test_every_operation_is_covered():
    assert set(SPECS) == set(OPS)


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(TRAIN, SCHEMA), spark.createDataFrame(SERVE, SCHEMA)


def test_a_row_alone_is_a_row_in_a_batch(frames):
    train, serve = frames
    specs = [{"op": o, "params": p} for o, p in SPECS.items()]
    model = FeatureTransformer(specs, "y").fit(train)
    made = model.output_columns
    batch = values(model.transform(serve), *made)
    for i, want in enumerate(batch):
        assert values(model.transform(serve.where(f"id = {i}")), *made) == [want]
    assert all(v is None or isinstance(v, float) for row in batch for v in row)
    assert values(model.transform(serve.union(serve)), *made) == [v for v in batch for _ in (0, 1)]


def test_transform_shuffles_nothing(frames):
    train, serve = frames
    model = FeatureTransformer([{"op": o, "params": p} for o, p in SPECS.items()], "y").fit(train)
    plan = model.transform(serve)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Sort " not in plan
    physical = model.transform(serve)._jdf.queryExecution().executedPlan().toString()
    # the learned tables are aggregated; the batch itself is only joined by broadcast
    assert "SortMergeJoin" not in physical


def fit_one(spark, rows, schema, op, params, target=None, serve=None):
    df = spark.createDataFrame(rows, schema)
    model = FeatureTransformer([FeatureSpec(op, params)], target).fit(df)
    return model.transform(spark.createDataFrame(serve, schema) if serve else df)


def test_frequency(spark):
    """Eight rows, one null: oats 3 / 8, rye 4 / 8."""
    rows = list(enumerate(["rye", "oats", "rye", "oats", "rye", None, "oats", "rye"]))
    out = values(fit_one(spark, rows, "id int, c string", "frequency_encode", {"col": "c"}, serve=[(0, "oats"), (1, "rye"), (2, "spelt"), (3, None)]), "c_freq")
    assert out == [(0.375,), (0.5,), (0.0,), (None,)]


def test_target_encoding(spark):
    """Mean of all 6; p: (2 + 4 + 3 * 6) / 5, q: (12 + 3 * 6) / 4, r: (3 + 9 + 6 + 3 * 6) / 6 with smoothing 3."""
    rows = list(zip(range(6), "ppqrrr", [2.0, 4.0, 12.0, 3.0, 9.0, 6.0], strict=True))
    out = values(fit_one(spark, rows, "id int, c string, y double", "target_encode", {"col": "c", "smoothing": 3.0}, "y", [(0, "p", 0.0), (1, "q", 0.0), (2, "r", 0.0), (3, "s", 0.0), (4, None, 0.0)]), "c_target_enc")
    assert [round(v[0], 6) if v[0] is not None else None for v in out] == [4.8, 7.5, 6.0, 6.0, None]


def test_group_aggregate_and_a_group_of_one(spark):
    rows = [(i, g, v) for i, (g, v) in enumerate([("u", 4.0), ("u", 10.0), ("u", 7.0), ("w", 31.0), (None, 8.0)])]
    schema = "id int, g string, v double"
    serve = [(0, "u", 0.0), (1, "w", 0.0), (2, "z", 0.0), (3, None, 0.0)]
    std = [r[0] for r in values(fit_one(spark, rows, schema, "group_aggregate", {"by": "g", "col": "v", "agg": "std"}, serve=serve), "v_std_by_g")]
    # over all five rows: squares 64, 4, 25, 361, 16 from the mean of 12
    assert std[0] == pytest.approx(3.0) and std[1] is None and std[2] == pytest.approx(math.sqrt(470 / 4)) and std[3] is None
    mean = [r[0] for r in values(fit_one(spark, rows, schema, "group_aggregate", {"by": "g", "col": "v"}, serve=serve), "v_mean_by_g")]
    assert mean == [7.0, 31.0, 12.0, None]


def test_ratio_log_product_and_dates(spark):
    rows = [(0, 9.0, 4.0), (1, -6.0, 0.0), (2, 0.0, 5.0), (3, None, 2.0)]
    assert values(fit_one(spark, rows, "id int, a double, b double", "ratio", {"a": "a", "b": "b"}), "a_ratio_b") == [(2.25,), (None,), (0.0,), (None,)]
    rows = [(0, -0.5), (1, math.e - 1), (2, 0.0), (3, None), (4, float("inf"))]
    assert [round(v[0], 9) if v[0] is not None else None for v in values(fit_one(spark, rows, "id int, a double", "log1p", {"col": "a"}), "a_log1p")] == [0.0, 1.0, 0.0, None, None]
    # 29 February 2016 was a Monday, 24 July 2022 a Sunday
    rows = [(0, "2016-02-29"), (1, "2022-07-24"), (2, None), (3, "later")]
    got = values(fit_one(spark, rows, "id int, t string", "datetime_parts", {"col": "t"}), "t_dayofweek", "t_month", "t_is_weekend")
    assert got == [(0.0, 2.0, 0.0), (6.0, 7.0, 1.0), (None, None, None), (None, None, None)]


def test_problems_are_reported_not_raised():
    cols = ["a", "b", "a_log1p"]
    assert validate_specs([{"op": "ratio", "params": {"a": "a", "b": "b"}}], cols) == []
    bad = [{"op": "nope", "params": {}}, {"op": "log1p", "params": {"col": "a"}}, {"op": "ratio", "params": {"a": "a"}}, {"op": "quantile_bin", "params": {"col": "a", "n_bins": 1}}, {"op": "group_aggregate", "params": {"by": "a", "col": "a"}}, {"op": "log1p", "params": {"col": "zz"}}, 5, {"op": "product", "params": {"a": "a", "b": "b", "c": 1}}]
    assert len(validate_specs(bad, cols)) == len(bad)
    good, rest = triage([*bad, {"op": "ratio", "params": {"a": "a", "b": "b"}}], cols)
    assert [s.op for s in good] == ["ratio"] and len(rest) == len(bad)
    assert len(validate_specs([{"op": "log1p", "params": {"col": "b"}}] * 2, cols)) == 1


def test_loud_failures(spark):
    df = spark.createDataFrame([(0, 1.0, "x"), (1, 1.0, "y")], "id int, a double, s string")
    for op, params in (("quantile_bin", {"col": "a"}), ("datetime_parts", {"col": "s"}), ("log1p", {"col": "s"}), ("target_encode", {"col": "s"})):
        with pytest.raises(ValueError):
            FeatureTransformer([FeatureSpec(op, params)]).fit(df)
    model = FeatureTransformer([FeatureSpec("log1p", {"col": "a"})]).fit(df)
    with pytest.raises(ValueError):
        model.transform(df.drop("a"))
    with pytest.raises(ValueError):
        model.transform(model.transform(df))
