"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.normality import LAST, LAST_BUT_ONE, normality
from .registry import query, table

NULLED = "o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 97 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_custkey"


def nulled(spark, d):
    return table(spark, d, "orders").selectExpr(*[c.strip() for c in NULLED.split(", ")])


def rounded(df, digits=6, **own):
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _union(parts):
    return " UNION ALL ".join(parts)


@query("prof_overview", _union(f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS DOUBLE) AS missing_pct, count(DISTINCT {c}) AS n_unique, count(*) AS n_rows FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def prof_overview(spark, d):
    return P.overview(table(spark, d, "part"))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_sql(c):
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, round(median({c}), 6) AS median,
    round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis, count(*) FILTER (WHERE {c} = 0) AS n_zeros, count(*) FILTER (WHERE {c} < 0) AS n_negatives,
    count(*) FILTER (WHERE {c} < q[1] - 1.5e0 * (q[2] - q[1]) OR {c} > q[2] + 1.5e0 * (q[2] - q[1])) AS n_outliers_iqr,
    {", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS p{p}" for p in P.PERCENTILES)} FROM lineitem, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM lineitem)"""


@query("prof_numeric", _union(map(_numeric_sql, NUM)))
def prof_numeric(spark, d):
    return rounded(P.numeric_stats(table(spark, d, "lineitem"), NUM))


def _categorical_sql(c, t):
    return f"""SELECT '{c}' AS "column", count(*) AS unique_count, round(count(*) / CAST(any_value(t) AS DOUBLE), 6) AS cardinality_ratio, round(sum(-(n / CAST(t AS DOUBLE)) * log2(n / CAST(t AS DOUBLE) + 1e-12)), 6) AS entropy,
    (array_agg(v ORDER BY n DESC, v))[1] AS mode, round(max(n / CAST(t AS DOUBLE)), 6) AS mode_frequency, count(*) FILTER (WHERE n / CAST(t AS DOUBLE) < 0.01e0) AS n_rare
    FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, sum(count(*)) OVER () AS t FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"""


@query("prof_categorical", _union([_categorical_sql("o_orderstatus", "orders"), _categorical_sql("o_orderpriority", "orders")]))
def prof_categorical(spark, d):
    return rounded(P.categorical_stats(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("prof_categorical_events", _union([_categorical_sql("event_type", "events"), _categorical_sql("user_id", "events")]))
def prof_categorical_events(spark, d):
    return rounded(P.categorical_stats(table(spark, d, "events"), ["event_type", "user_id"]))


@query("prof_top_values", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def prof_top_values(spark, d):
    return P.top_values(table(spark, d, "part"), "p_brand")


@query("prof_rare_values", "WITH c AS (SELECT CAST(p_brand AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 1) SELECT value, n FROM c, (SELECT sum(n) AS t FROM c) WHERE n < 0.04e0 * t ORDER BY n DESC, value LIMIT 20")
def prof_rare_values(spark, d):
    return P.rare_values(table(spark, d, "part"), "p_brand", 0.04)


@query("prof_samples", "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS i, price_text AS value FROM (SELECT o_orderkey, o_orderstatus AS price_text FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 97 <> 0 ORDER BY o_orderkey LIMIT 5)")
def prof_samples(spark, d):
    return P.ordered_head(nulled(spark, d), "status", "o_orderkey")


@query(
    "prof_datetime",
    """SELECT min(o_orderdate) AS min_date, max(o_orderdate) AS max_date, CAST(floor((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400) AS BIGINT) AS range_days,
    CAST((SELECT isodow(o_orderdate) - 1 AS w FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS INTEGER) AS modal_dow, CAST((SELECT month(o_orderdate) FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS INTEGER) AS modal_month FROM orders""",
)
def prof_datetime(spark, d):
    return P.datetime_stats(table(spark, d, "orders"), "o_orderdate")


@query(
    "prof_text",
    r"""SELECT round(avg(length(text)), 6) AS avg_length, CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length,
    (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS w FROM documents) WHERE w <> '') AS vocabulary_size FROM documents""",
)
def prof_text(spark, d):
    return rounded(P.text_stats(table(spark, d, "documents"), "text"))


@query("prof_target_class", "WITH c AS (SELECT CAST(l_returnflag AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT value, n, round(n / CAST(t AS DOUBLE), 6) AS share, round(CAST(lo AS DOUBLE) / hi, 6) AS imbalance, k = 2 AS is_binary FROM c, (SELECT sum(n) AS t, min(n) AS lo, max(n) AS hi, count(*) AS k FROM c)")
def prof_target_class(spark, d):
    return rounded(P.class_balance(table(spark, d, "lineitem"), "l_returnflag"))


@query("prof_target_reg", "SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(skewness(o_totalprice), 6) AS skew, skewness(o_totalprice) > 1 AS log_benefit FROM orders")
def prof_target_reg(spark, d):
    return rounded(P.target_stats(table(spark, d, "orders"), "o_totalprice"), mean=4, std=4)


@query("prof_correlation", _union(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r FROM lineitem" for i, a in enumerate(NUM) for b in NUM[i + 1 :]))
def prof_correlation(spark, d):
    return rounded(P.correlations(table(spark, d, "lineitem"), NUM))


def _association_sql(c):
    return f"""SELECT '{c}' AS "column", round(sum(f * f / e) / any_value(n), 6) AS phi2, CAST(any_value(n) AS BIGINT) AS n FROM (
    SELECT n, e, CASE WHEN kx = 2 AND ky = 2 THEN abs(o - e) - least(0.5e0, abs(o - e)) ELSE abs(o - e) END AS f FROM (
    SELECT n, kx, ky, coalesce(o, 0) AS o, CAST(nx AS DOUBLE) * ny / n AS e FROM (SELECT {c} AS x, count(*) AS nx FROM t GROUP BY 1) CROSS JOIN (SELECT y, count(*) AS ny FROM t GROUP BY 1)
    LEFT JOIN (SELECT {c} AS x2, y AS y2, count(*) AS o FROM t GROUP BY 1, 2) ON x = x2 AND y = y2, (SELECT count(*) AS n, count(DISTINCT {c}) AS kx, count(DISTINCT y) AS ky FROM t)))"""


@query("prof_association", "WITH t AS (SELECT coalesce(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END, 'MISSING') AS s, coalesce(o_orderpriority, 'MISSING') AS p, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS h, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS y FROM orders) " + _union(map(_association_sql, "sph")))
def prof_association(spark, d):
    df = table(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s", "o_orderpriority AS p", "CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS h", "CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS y")
    return rounded(P.association(df, ["s", "p", "h"], "y"))


@query("prof_missing", f"WITH t AS (SELECT {NULLED} FROM orders) SELECT \"column\", round(pct, 2) AS missing_pct, CASE WHEN pct > 30 THEN 'drop' WHEN pct > 5 THEN 'advanced_imputation' WHEN pct > 0 THEN 'simple_imputation' ELSE 'none' END AS recommendation FROM (" + _union(f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100 / count(*) AS pct FROM t" for c in ("o_orderkey", "price", "status", "priority", "o_custkey")) + ")")
def prof_missing(spark, d):
    return P.missing(nulled(spark, d))


_FLAGS = ["price", "status", "priority"]


@query("prof_co_missing", f"WITH t AS (SELECT {NULLED} FROM orders), f AS (SELECT {', '.join(f'CAST({c} IS NULL AS DOUBLE) AS {c}' for c in _FLAGS)} FROM t) SELECT * FROM (" + _union(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r FROM f" for i, a in enumerate(_FLAGS) for b in _FLAGS[i + 1 :]) + ") WHERE r > 0.5")
def prof_co_missing(spark, d):
    return rounded(P.co_missing(nulled(spark, d), _FLAGS))


def _outlier_sql(c):
    return f"""SELECT '{c}' AS "column", n_iqr, n_z, CASE WHEN CAST(n_iqr AS DOUBLE) / n > 0.01e0 THEN 'clip' ELSE 'none' END AS recommendation FROM (
    SELECT count({c}) AS n, count(*) FILTER (WHERE {c} < q[1] - 1.5e0 * (q[2] - q[1]) OR {c} > q[2] + 1.5e0 * (q[2] - q[1])) AS n_iqr, count(*) FILTER (WHERE abs(({c} - m) / s) > 3) AS n_z
    FROM t, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q, avg({c}) AS m, stddev_pop({c}) AS s FROM t))"""


_SPIKED = "l_extendedprice, l_quantity, CASE WHEN l_partkey % 50 = 0 THEN l_quantity * 20 ELSE l_quantity END AS spiked"


@query("prof_outliers", f"WITH t AS (SELECT {_SPIKED} FROM lineitem) " + _union(map(_outlier_sql, ["l_extendedprice", "l_quantity", "spiked"])))
def prof_outliers(spark, d):
    return P.outliers(table(spark, d, "lineitem").selectExpr("l_extendedprice", "l_quantity", "CASE WHEN l_partkey % 50 = 0 THEN l_quantity * 20 ELSE l_quantity END AS spiked"), ["l_extendedprice", "l_quantity", "spiked"])


@query("prof_duplicates", "SELECT round(1 - CAST((SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)) AS DOUBLE) / count(*), 6) AS duplicate_ratio FROM part")
def prof_duplicates(spark, d):
    return rounded(P.duplicate_ratio(table(spark, d, "part").select("p_brand", "p_type", "p_size")))


@query(
    "prof_quality",
    r"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '17' END AS code, o_orderpriority, o_orderdate FROM orders),
    n AS (SELECT count(*) AS n, (count(*) FILTER (WHERE price IS NULL)) / (count(*) * 5.0e0) AS nulls FROM t),
    w AS (SELECT (SELECT count(*) FROM t, (SELECT quantile_cont(price, [0.25, 0.75]) AS q FROM t) WHERE price < q[1] - 1.5e0 * (q[2] - q[1]) OR price > q[2] + 1.5e0 * (q[2] - q[1])) AS w),
    p AS (SELECT 100 * (1 - nulls) AS completeness, 100.0e0 AS uniqueness, 90.0e0 AS type_consistency, 90.0e0 - 2 * CAST(w > 0.1e0 * n AS INTEGER) AS validity,
    greatest(50e0, 100 - date_diff('day', (SELECT CAST(max(o_orderdate) AS DATE) FROM t), DATE '2000-01-01') / 365e0 * 10) AS timeliness FROM n, w)
    SELECT round(completeness, 6) AS completeness, uniqueness, type_consistency, validity, round(timeliness, 6) AS timeliness, round(completeness * 0.3e0 + uniqueness * 0.2e0 + type_consistency * 0.2e0 + validity * 0.2e0 + timeliness * 0.1e0, 1) AS score FROM p""",
)
def prof_quality(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '17' END AS code", "o_orderpriority", "o_orderdate")
    return rounded(P.quality(df, ["o_orderdate"], "o_orderkey", "2000-01-01"))


_TYPES = {
    "orders": {"o_orderkey": "ID", "o_custkey": "NUMERICAL", "o_orderstatus": "CATEGORICAL", "o_totalprice": "NUMERICAL", "o_orderdate": "DATETIME", "o_orderpriority": "CATEGORICAL"},
    "documents": {"doc_id": "ID", "text": "TEXT", "lang": "CATEGORICAL", "source": "CATEGORICAL", "n_chars": "NUMERICAL"},
    "labels": {"doc_id": "ID", "quality": "BINARY", "toxic": "BINARY"},
    "events": {"event_id": "ID", "ts": "DATETIME", "user_id": "ID", "event_type": "CATEGORICAL", "value": "NUMERICAL", "props": "CATEGORICAL"},
}


@query("prof_types", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{k}')" for t, cols in _TYPES.items() for c, k in cols.items()) + ") AS v(tbl, \"column\", kind)")
def prof_types(spark, d):
    rows = [(t, c, k) for t in _TYPES for c, k in P.semantic_types(table(spark, d, t), order=next(iter(_TYPES[t]))).items()]
    return spark.createDataFrame(rows, "tbl string, column string, kind string")


@query("prof_output_checks", "SELECT 'half' AS \"column\", false AS constant, round(avg(CAST(o_orderkey % 3 <> 0 AS DOUBLE)), 6) AS null_share, avg(CAST(o_orderkey % 3 <> 0 AS DOUBLE)) <= 0.5 AS ok FROM orders UNION ALL SELECT 'flat', true, 0.0e0, false UNION ALL SELECT 'fine', false, 0.0e0, true")
def prof_output_checks(spark, d):
    df = table(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS half", "1 AS flat", "o_totalprice * 2 AS fine")
    return rounded(P.check_outputs(df, ["half", "flat", "fine"]))


def _normality_sql() -> str:
    """W of suppliers' balances; the normal scores by a rational approximation."""
    # fixed values: coefficients of the approximation, highest power first
    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
    # end of fixed values
    horner = lambda cs, x: " + ".join(f"({v!r}::DOUBLE) * power({x}, {len(cs) - 1 - i})" for i, v in enumerate(cs))
    tail = lambda q: f"({horner(c, q)}) / ({horner(d, q)})"
    t = "sqrt(-2 * ln(least(q, 1 - q)))"
    score = f"CASE WHEN q < 0.02425 THEN {tail(t)} WHEN q > 0.97575 THEN -({tail(t)}) ELSE (q - 0.5) * ({horner(a, '((q - 0.5) * (q - 0.5))')}) / ({horner(b, '((q - 0.5) * (q - 0.5))')}) END"
    poly = lambda cs: " + ".join(f"({v!r}) * power(u, {i})" for i, v in enumerate(cs))
    return f"""WITH x AS (SELECT s_acctbal::DOUBLE AS v, row_number() OVER (ORDER BY s_acctbal) AS i, count(*) OVER () AS n FROM supplier),
    m AS (SELECT *, {score} AS m FROM (SELECT *, (i - 0.375) / (n + 0.25) AS q FROM x)),
    s AS (SELECT sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (WHERE i = n - 1) AS m2, any_value(n) AS n, 1 / sqrt(any_value(n)) AS u FROM m),
    o AS (SELECT *, m1 / sqrt(mm) + {poly(LAST)} AS a1, m2 / sqrt(mm) + {poly(LAST_BUT_ONE)} AS a2 FROM s),
    f AS (SELECT *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS r FROM o),
    w AS (SELECT m.v, m.n, CASE m.i WHEN 1 THEN -a1 WHEN 2 THEN -a2 WHEN m.n - 1 THEN a2 WHEN m.n THEN a1 ELSE m.m / r END AS a FROM m, f)
    SELECT 's_acctbal' AS "column", any_value(n) AS n, round(power(sum(a * v), 2) / (var_pop(v) * count(*)), 5) AS w FROM w"""


@query("prof_normality", _normality_sql())
def prof_normality(spark, d):
    return normality(table(spark, d, "supplier"), ["s_acctbal"], ["s_suppkey"]).select("column", "n", F.round("w", 5).alias("w"))
