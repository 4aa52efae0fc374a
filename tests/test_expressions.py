"""Expressions of others: what is refused, and what is added."""

from __future__ import annotations

import pytest

from lumen.operators import expressions as X


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, float(i % 7), "ab c"[i % 4], None if i % 3 else 1.0, float(i % 2)) for i in range(60)], "n int, v double, t string, gap double, y double")


@pytest.mark.parametrize("text, why", [
    ("y + 1", "no column"), ("nothing * 2", "no column"), ("V * 2", "no column"), ("df.v", "no column"), ("n.v", "no column"),
    ("reflect('java.lang.Runtime', 'getRuntime')", "reflect"), ("java_method('java.lang.System', 'exit', 1)", "java_method"), ("rand() * v", "rand"), ("uuid()", "uuid"), ("current_timestamp()", "not allowed"), ("input_file_name()", "input_file_name"), ("monotonically_increasing_id() + v", "not allowed"),
    ("(SELECT max(v) FROM x)", "ScalarSubquery"), ("EXISTS (SELECT 1)", "Exists"), ("v IN (SELECT 1)", "not allowed"), ("sum(v)", "sum"), ("row_number() OVER (ORDER BY v)", "not allowed"), ("explode(array(v))", "not allowed"), ("*", "not allowed"), ("transform(array(v), x -> x)", "not allowed"),
    ("repeat(t, 1000000000)", "repeat"), ("sequence(1, 1000000000)", "sequence"), ("spark_catalog.default.f(v)", "not allowed"), ("raise_error(t)", "raise_error"),
    ("v; DROP TABLE x", "cannot be read"), ("v +", "cannot be read"), ("", "empty"), ("1 + 2", "uses no column"), ("v + " * 600 + "v", "characters"), ("+".join(["v"] * 150), "parts"), ("lower(t, t, t)", "fit"), ("count(DISTINCT v)", "count"), ("max(v) FILTER (WHERE v > 1)", "max"), (None, "empty"),
])
def test_hostile_expressions_are_refused(df, text, why):
    with pytest.raises(X.Refused, match=why):
        X.checked(df, text, "y")


def test_what_stands_is_added(df):
    out, report = X.add_columns(df, {"a": "v * 2 + coalesce(gap, 0)", "b": "CASE WHEN t = 'a' THEN v WHEN t LIKE 'b%' THEN -v ELSE length(t) END", "v": "n + 1", "flat": "v - v", "void": "gap * v", "bad": "rand() + v", "c": "CAST(n AS double) / greatest(v, 1)", "when": "n BETWEEN 3 AND 5 OR v IS NULL"}, "y")
    assert out.columns == [*df.columns, "a", "b", "c", "when"]
    assert {r["name"]: r["reason"] for r in report} == {"a": None, "b": None, "v": "the table has a column of this name", "flat": "it is constant", "void": "it is null in 67% of the rows", "bad": "the function 'rand' is not allowed", "c": None, "when": None}
    for r in out.collect():
        assert r["a"] == r["v"] * 2 + (r["gap"] or 0) and r["c"] == r["n"] / max(r["v"], 1) and r["when"] == (3 <= r["n"] <= 5)
        assert r["b"] == (r["v"] if r["t"] == "a" else -r["v"] if r["t"] == "b" else 1)
    same, none = X.add_columns(df, {})
    assert same.columns == df.columns and none == []
