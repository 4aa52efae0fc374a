"""Drift and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..streaming import drift as stream_drift
from ..streaming import monitor
from .profile import rounded
from .registry import query, table


def _numeric_sql(c, e, a):
    bins = ", ".join(f"count(*) FILTER (WHERE x >= e[{k}] AND x {'<=' if k == 10 else '<'} e[{k + 1}]) / CAST(count(x) AS DOUBLE)" for k in range(1, 11))
    return f"""(SELECT sum((a - e) * ln(a / e)) FROM (SELECT greatest(e, 0.001e0) / sum(greatest(e, 0.001e0)) OVER () AS e, greatest(a, 0.001e0) / sum(greatest(a, 0.001e0)) OVER () AS a FROM (
    SELECT unnest((SELECT [{bins}] FROM (SELECT {c} AS x FROM {e}), r_{c})) AS e, unnest((SELECT [{bins}] FROM (SELECT {c} AS x FROM {a}), r_{c})) AS a)))"""


def _range_sql(c, e):
    return f"r_{c} AS (SELECT [lo - 1e-6, {', '.join(f'lo + (hi - lo) / 10 * {k}' for k in range(1, 10))}, hi + 1e-6] AS e FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {e}))"


_ORDERS = "b AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01'), c AS (SELECT *  REPLACE (o_totalprice * 1.2e0 AS o_totalprice) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01')"


def orders(spark, d):
    df = table(spark, d, "orders")
    return df.where("o_orderdate < TIMESTAMP_NTZ '1996-06-01'"), df.where("o_orderdate >= TIMESTAMP_NTZ '1996-06-01'").withColumn("o_totalprice", F.col("o_totalprice") * 1.2)


@query("drift_psi_numeric", f"WITH {_ORDERS}, {_range_sql('o_totalprice', 'b')} SELECT 'o_totalprice' AS \"column\", round({_numeric_sql('o_totalprice', 'b', 'c')}, 6) AS psi")
def drift_psi_numeric(spark, d):
    return rounded(D.psi_numeric(*orders(spark, d), ["o_totalprice"]))


def _categorical_sql(c, e, a):
    return f"""(SELECT sum((a - e) * ln(a / e)) FROM (SELECT greatest(e, 0.001e0) / sum(greatest(e, 0.001e0)) OVER () AS e, greatest(coalesce(a, 0), 0.001e0) / sum(greatest(coalesce(a, 0), 0.001e0)) OVER () AS a FROM
    (SELECT {c} AS v, count(*) / CAST((SELECT count({c}) FROM {e}) AS DOUBLE) AS e FROM {e} WHERE {c} IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT {c} AS v, count(*) / CAST((SELECT count({c}) FROM {a}) AS DOUBLE) AS a FROM {a} WHERE {c} IS NOT NULL GROUP BY 1) USING (v)))"""


@query("drift_psi_categorical", "WITH b AS (SELECT event_type FROM events WHERE event_id % 2 = 0 AND event_type <> 'click'), c AS (SELECT event_type FROM events WHERE event_id % 2 = 1 AND value > 20) SELECT 'event_type' AS \"column\", round(" + _categorical_sql("event_type", "b", "c") + ", 6) AS psi")
def drift_psi_categorical(spark, d):
    """A category that the baseline lacks."""
    df = table(spark, d, "events")
    return rounded(D.psi_categorical(df.where("event_id % 2 = 0 AND event_type <> 'click'"), df.where("event_id % 2 = 1 AND value > 20"), ["event_type"]))


@query("drift_report", f"WITH {_ORDERS}, {_range_sql('o_totalprice', 'b')}, {_range_sql('o_custkey', 'b')}, r AS (SELECT 'o_totalprice' AS \"column\", {_numeric_sql('o_totalprice', 'b', 'c')} AS p UNION ALL SELECT 'o_custkey', {_numeric_sql('o_custkey', 'b', 'c')} UNION ALL SELECT 'o_orderstatus', {_categorical_sql('o_orderstatus', 'b', 'c')} UNION ALL SELECT 'o_orderpriority', {_categorical_sql('o_orderpriority', 'b', 'c')}) SELECT \"column\", round(p, 4) AS psi, p > 0.25 AS drifted, round(avg(round(p, 4)) OVER (), 6) AS overall FROM r")
def drift_report(spark, d):
    return rounded(D.drift_report(*orders(spark, d), ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"]))


@query("drift_self", "SELECT 'o_totalprice' AS \"column\", 0.0e0 AS psi, false AS drifted, 0.0e0 AS overall UNION ALL SELECT 'o_orderstatus', 0.0e0, false, 0.0e0")
def drift_self(spark, d):
    df = table(spark, d, "orders")
    return rounded(D.drift_report(df, df, ["o_totalprice", "o_orderstatus"])).select("column", F.abs("psi").alias("psi"), "drifted", F.abs("overall").alias("overall"))


@query("mon_latency", "SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE) AS error_rate, round(quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error'), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (WHERE event_type <> 'error'), 6) AS p95, round(quantile_cont(value, 0.99) FILTER (WHERE event_type <> 'error'), 6) AS p99, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS avg_confidence FROM events")
def mon_latency(spark, d):
    return rounded(D.serving_summary(table(spark, d, "events"), "value", F.col("event_type") == "error", "value"), error_rate=15)


@query("mon_latency_latest", "SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error'), 6) AS p50 FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500)")
def mon_latency_latest(spark, d):
    """The last 500 requests, as a bounded buffer keeps them."""
    return rounded(D.serving_summary(table(spark, d, "events"), "value", F.col("event_type") == "error", None, 500, "event_id").select("requests", "errors", "p50"))


@query("mon_predictions", "SELECT event_type AS prediction, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY 1")
def mon_predictions(spark, d):
    return rounded(D.prediction_distribution(table(spark, d, "events"), "event_type"))


@query("stream_perf_windows", "SELECT date_trunc('hour', ts) AS start, event_type AS \"group\", count(*) AS n, count(*) FILTER (WHERE value > 50) AS errors, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY 1, 2")
def stream_perf_windows(spark, d):
    """The windowed summary over the table; tests/test_streaming.py runs the same plan as a stream."""
    out = monitor.windows(table(spark, d, "events"), "ts", "event_type", "value", F.col("value") > 50)
    return rounded(out)


def _windows_sql() -> str:
    """Daily stability of events' values and types against their first week."""
    inside = " ".join(f"WHEN value < lo + (hi - lo) / 10 * {k} THEN {k - 1}" for k in range(1, 10))
    rows = f"""v AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE ts < TIMESTAMP '2024-01-08'),
    r AS (SELECT ts, 'value' AS "column", CASE WHEN value < lo - 1e-6 OR value > hi + 1e-6 THEN '-' ELSE CAST(CASE {inside} ELSE 9 END AS VARCHAR) END AS cell FROM events, v WHERE value IS NOT NULL UNION ALL SELECT ts, 'event_type', event_type FROM events WHERE event_type IS NOT NULL)"""
    return f"""WITH {rows},
    t AS (SELECT date_trunc('day', ts) AS start, "column", count(*) AS n FROM r WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY ALL),
    names AS (SELECT DISTINCT "column", cell FROM r WHERE ts < TIMESTAMP '2024-01-08' AND "column" = 'event_type' UNION ALL SELECT 'value', CAST(i AS VARCHAR) FROM range(10) s(i)),
    b AS (SELECT "column", count(*) AS n FROM r WHERE ts < TIMESTAMP '2024-01-08' GROUP BY ALL),
    e AS (SELECT names."column", names.cell, greatest(count(r.cell) / any_value(b.n), 0.001) AS e FROM names JOIN b ON b."column" = names."column" LEFT JOIN r ON r."column" = names."column" AND r.cell = names.cell AND r.ts < TIMESTAMP '2024-01-08' GROUP BY names."column", names.cell),
    a AS (SELECT t.start, e."column", e.cell, any_value(e.e) AS e, any_value(t.n) AS n, greatest(count(r.cell) / any_value(t.n), 0.001) AS a FROM t JOIN e ON e."column" = t."column" LEFT JOIN r ON r."column" = e."column" AND r.cell = e.cell AND date_trunc('day', r.ts) = t.start GROUP BY t.start, e."column", e.cell),
    w AS (SELECT start, "column", n, e / sum(e) OVER p AS e, a / sum(a) OVER p AS a FROM a WINDOW p AS (PARTITION BY start, "column"))
    SELECT start, "column", n, round(sum((a - e) * ln(a / e)), 6) AS psi, sum((a - e) * ln(a / e)) > 0.25 AS drifted FROM w GROUP BY start, "column", n"""


@query("drift_windows", _windows_sql())
def drift_windows(spark, d):
    """Each day against the first week; the same aggregation runs over a stream."""
    events = table(spark, d, "events")
    first = events.where("ts < timestamp_ntz'2024-01-08 00:00:00'")
    out = stream_drift.drift_windows(events.where("ts >= timestamp_ntz'2024-01-08 00:00:00'"), "ts", stream_drift.Baseline.of(first, ["value", "event_type"]), "1 day")
    return out.withColumn("psi", F.round("psi", 6))
