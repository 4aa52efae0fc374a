"""Preprocessing and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep as R
from ..operators.information import neighbour_information
from .features import LINE, LINE_SQL
from .profile import nulled, rounded
from .registry import query, table

_NULLED_SQL = "(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 97 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders)"


@query("prep_clip", f"SELECT {LINE_SQL}, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS clipped FROM (SELECT *, least(greatest(l_extendedprice, lo), hi) AS x FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem))")
def prep_clip(spark, d):
    """Clipped to the 1st and 99th percentile, then standardised."""
    df = table(spark, d, "lineitem").withColumn("clipped", F.col("l_extendedprice"))
    return rounded(R.Preprocessor(["clipped"], [], ["clipped"], LINE).fit(df).transform(df), l_extendedprice=15)


@query("prep_impute_median", f"SELECT o_orderkey, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS price FROM (SELECT o_orderkey, coalesce(price, m) AS x FROM {_NULLED_SQL}, (SELECT median(price) AS m FROM {_NULLED_SQL}))")
def prep_impute_median(spark, d):
    df = nulled(spark, d)
    return rounded(R.Preprocessor(["price"], [], [], ["o_orderkey"]).fit(df).transform(df))


@query("prep_impute_mode", f"SELECT o_orderkey, coalesce(status, (SELECT status FROM {_NULLED_SQL} WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS status FROM {_NULLED_SQL}")
def prep_impute_mode(spark, d):
    return R.impute_mode(nulled(spark, d), "status").select("o_orderkey", "status")


@query("prep_standard_scale", "SELECT p_partkey, round((p_retailprice - m) / s, 6) AS p_retailprice, round((p_size - ms) / ss, 6) AS p_size FROM part, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, avg(p_size) AS ms, stddev_pop(p_size) AS ss FROM part WHERE p_partkey % 5 <> 0)")
def prep_standard_scale(spark, d):
    df = table(spark, d, "part")
    return rounded(R.Preprocessor(["p_retailprice", "p_size"], [], [], ["p_partkey"]).fit(df.where("p_partkey % 5 <> 0")).transform(df))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("prep_one_hot", "SELECT o_orderkey, " + ", ".join(f"CAST(coalesce(o_orderpriority, 'MISSING') = '{p}' AS DOUBLE) AS \"o_orderpriority_{p}\"" for p in _PRIORITIES[:4]) + " FROM orders")
def prep_one_hot(spark, d):
    """One priority is unknown to training: zeros."""
    df = table(spark, d, "orders")
    return R.Preprocessor([], ["o_orderpriority"], [], ["o_orderkey"]).fit(df.where("o_orderpriority <> '5-LOW'")).transform(df)


@query("prep_label_encode", f"SELECT {LINE_SQL}, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label FROM lineitem")
def prep_label_encode(spark, d):
    return R.label_index(table(spark, d, "lineitem"), "l_returnflag").select(*LINE, "label")


@query("prep_missing_indicator", f"SELECT o_orderkey, CAST(price IS NULL AS INTEGER) AS price_is_missing, CAST(status IS NULL AS INTEGER) AS status_is_missing FROM {_NULLED_SQL}")
def prep_missing_indicator(spark, d):
    return R.missing_indicators(nulled(spark, d), ["price", "status"]).select("o_orderkey", "price_is_missing", "status_is_missing")


@query("prep_stratified_split", f"SELECT l_returnflag, is_test, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {LINE_SQL}) <= round(count(*) OVER (PARTITION BY l_returnflag) * 0.2e0) AS is_test FROM lineitem) GROUP BY 1, 2")
def prep_stratified_split(spark, d):
    out = R.stratified(table(spark, d, "lineitem"), "l_returnflag", [F.col(c) for c in LINE])
    return out.groupBy("l_returnflag", "is_test").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("prep_kfold", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def prep_kfold(spark, d):
    return R.kfold(table(spark, d, "orders"), [F.col("o_orderkey")], 5, "o_orderstatus").select("o_orderkey", "fold")


@query("prep_drop_null_target", f"SELECT * FROM {_NULLED_SQL} WHERE price IS NOT NULL")
def prep_drop_null_target(spark, d):
    return R.drop_null_target(nulled(spark, d).select("o_orderkey", "price", "status"), "price")


@query("prep_split_sizes", "SELECT o_orderstatus, count(*) AS n, CAST(round(count(*) * 0.2e0) AS BIGINT) AS n_test FROM orders GROUP BY 1")
def prep_split_sizes(spark, d):
    out = R.split(table(spark, d, "orders"), ["o_orderkey"], 0.2, "o_orderstatus")
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


@query("prep_hash_split")
def prep_hash_split(spark, d):
    """The library's default split, by a hash that SQL engines do not share."""
    return R.split(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


_MADE = "l_extendedprice, l_quantity, l_discount, l_extendedprice * 2 + l_discount AS twice, l_quantity + l_discount / 1000 AS thrice, l_extendedprice * l_discount AS y"


@query(
    "sel_correlation_filter",
    f"""WITH t AS (SELECT {_MADE} FROM lineitem), c AS (SELECT corr(l_extendedprice, twice) AS a, corr(l_quantity, thrice) AS b, abs(corr(l_extendedprice, y)) AS pe, abs(corr(twice, y)) AS pt, abs(corr(l_quantity, y)) AS pq, abs(corr(thrice, y)) AS ph FROM t)
    SELECT CASE WHEN pe < pt THEN 'l_extendedprice' ELSE 'twice' END AS dropped, CASE WHEN pe < pt THEN 'twice' ELSE 'l_extendedprice' END AS kept, round(a, 6) AS r FROM c UNION ALL SELECT CASE WHEN pq < ph THEN 'l_quantity' ELSE 'thrice' END, CASE WHEN pq < ph THEN 'thrice' ELSE 'l_quantity' END, round(b, 6) FROM c""",
)
def sel_correlation_filter(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_extendedprice", "l_quantity", "l_discount", "l_extendedprice * 2 + l_discount AS twice", "l_quantity + l_discount / 1000 AS thrice", "l_extendedprice * l_discount AS y")
    rows = R.correlation_filter(df, ["l_extendedprice", "l_quantity", "l_discount", "twice", "thrice"], "y")
    return rounded(spark.createDataFrame(rows, "dropped string, kept string, r double"))


@query(
    "sel_mi_binned",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(sum(n / CAST(t AS DOUBLE) * ln(n * t / (CAST(nx AS DOUBLE) * ny))), 6) AS mi FROM (
        SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM (
        SELECT least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS x, l_returnflag AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem) GROUP BY 1, 2))"""
        for c in ("l_quantity", "l_extendedprice", "l_tax")
    ),
)
def sel_mi_binned(spark, d):
    return rounded(R.binned_mutual_information(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "l_returnflag"))


@query(
    "sel_mi_neighbours",
    """WITH t AS (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS x, o_orderstatus AS y FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL),
    s AS (SELECT x, y, count(*) OVER (PARTITION BY y) AS size, least(coalesce(x - lag(x, 3) OVER w, 1e18), greatest(coalesce(x - lag(x, 2) OVER w, 1e18), coalesce(lead(x, 1) OVER w - x, 1e18)), greatest(coalesce(x - lag(x, 1) OVER w, 1e18), coalesce(lead(x, 2) OVER w - x, 1e18)), coalesce(lead(x, 3) OVER w - x, 1e18))::BIGINT AS d FROM t WINDOW w AS (PARTITION BY y ORDER BY x)),
    m AS (SELECT size, count(*) OVER (ORDER BY x RANGE BETWEEN greatest(d - 1, 0) PRECEDING AND greatest(d - 1, 0) FOLLOWING) AS m, count(*) OVER () AS n FROM s),
    h AS (SELECT i, coalesce(sum(1.0 / (i - 1)) FILTER (WHERE i > 1) OVER (ORDER BY i), 0) - 0.5772156649015329 AS psi FROM range(1, (SELECT count(*) + 1 FROM t)) r(i))
    SELECT 'price' AS feature, round(greatest(0, avg(a.psi) + (SELECT psi FROM h WHERE i = 3) - avg(b.psi) - avg(c.psi)), 6) AS mi FROM m JOIN h a ON a.i = m.n JOIN h b ON b.i = m.size JOIN h c ON c.i = m.m""",
)
def sel_mi_neighbours(spark, d):
    """Information of an order's price on its status; SQL sorts the whole table, the operator does not."""
    df = table(spark, d, "orders").select(F.round(F.col("o_totalprice") * 100).alias("price"), "o_orderstatus")
    return rounded(neighbour_information(df, ["price"], "o_orderstatus"), 6)
