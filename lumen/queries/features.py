"""Feature operations over the star-schema tables.

Training rows are those whose key is not divisible by 5; keys below are unique,
or the five columns that identify a line item.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import persist
from ..operators.expressions import add_columns
from ..operators.features import FeatureSpec, FeatureTransformer
from ..operators.ordered import ordered_target
from .registry import ORACLES, query, table

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
LINE_SQL = ", ".join(LINE)


@query("feat_log1p", f"SELECT {LINE_SQL}, CASE WHEN x IS NOT NULL THEN round(ln(1 + greatest(x, 0)), 6) END AS x_log1p FROM (SELECT *, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 1 THEN -l_extendedprice ELSE l_extendedprice END AS x FROM lineitem)")
def feat_log1p(spark, d):
    df = table(spark, d, "lineitem").withColumn("x", F.expr("CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 1 THEN -l_extendedprice ELSE l_extendedprice END"))
    out = FeatureTransformer([FeatureSpec("log1p", {"col": "x"})]).fit(df).transform(df)
    return out.select(*LINE, F.round("x_log1p", 6).alias("x_log1p"))


@query("feat_ratio", f"SELECT {LINE_SQL}, l_extendedprice / nullif(l_quantity - 1, 0) AS l_extendedprice_ratio_q FROM lineitem")
def feat_ratio(spark, d):
    df = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity") - 1)
    return FeatureTransformer([{"op": "ratio", "params": {"a": "l_extendedprice", "b": "q"}}]).fit(df).transform(df).select(*LINE, "l_extendedprice_ratio_q")


@query("feat_product", f"SELECT {LINE_SQL}, l_extendedprice * l_discount AS l_extendedprice_x_l_discount FROM lineitem")
def feat_product(spark, d):
    df = table(spark, d, "lineitem")
    return FeatureTransformer([{"op": "product", "params": {"a": "l_extendedprice", "b": "l_discount"}}]).fit(df).transform(df).select(*LINE, "l_extendedprice_x_l_discount")


@query("feat_datetime_parts", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate_dayofweek, CAST(month(o_orderdate) AS DOUBLE) AS o_orderdate_month, CAST(isodow(o_orderdate) >= 6 AS DOUBLE) AS o_orderdate_is_weekend FROM orders")
def feat_datetime_parts(spark, d):
    df = table(spark, d, "orders")
    return FeatureTransformer([{"op": "datetime_parts", "params": {"col": "o_orderdate"}}]).fit(df).transform(df).select("o_orderkey", "o_orderdate_dayofweek", "o_orderdate_month", "o_orderdate_is_weekend")


@query(
    "feat_datetime_parse",
    """SELECT event_id, CAST(isodow(t) - 1 AS DOUBLE) AS s_dayofweek, CAST(month(t) AS DOUBLE) AS s_month, CAST(isodow(t) >= 6 AS DOUBLE) AS s_is_weekend
    FROM (SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE CAST(ts AS DATE) END AS t FROM events)""",
)
def feat_datetime_parse(spark, d):
    """Texts in two patterns, with nulls and texts that are no date."""
    day = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'not a date' WHEN event_id % 2 = 0 THEN date_format(ts, 'yyyy-MM-dd') ELSE date_format(ts, 'yyyy/MM/dd') END"
    df = table(spark, d, "events").withColumn("s", F.expr(day))
    return FeatureTransformer([{"op": "datetime_parts", "params": {"col": "s"}}]).fit(df).transform(df).select("event_id", "s_dayofweek", "s_month", "s_is_weekend")


@query(
    "feat_winsorize",
    f"""WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem WHERE l_orderkey % 5 <> 0)
    SELECT {LINE_SQL}, round(least(greatest(l_extendedprice, lo), hi), 6) AS l_extendedprice_winsor FROM lineitem, b WHERE l_orderkey % 5 = 0""",
)
def feat_winsorize(spark, d):
    df = table(spark, d, "lineitem")
    model = FeatureTransformer([{"op": "winsorize", "params": {"col": "l_extendedprice"}}]).fit(df.where("l_orderkey % 5 <> 0"))
    return model.transform(df.where("l_orderkey % 5 = 0")).select(*LINE, F.round("l_extendedprice_winsor", 6).alias("l_extendedprice_winsor"))


@query(
    "feat_quantile_bin",
    """WITH b AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS e4, quantile_cont(p_retailprice, [1e0 / 3, 2e0 / 3]) AS e3 FROM part WHERE p_partkey % 5 <> 0)
    SELECT p_partkey, CAST(len(list_filter(e4, lambda e: e <= p_retailprice)) AS DOUBLE) AS p_retailprice_bin4, CAST(len(list_filter(e3, lambda e: e <= p_retailprice)) AS DOUBLE) AS p_retailprice_bin3 FROM part, b""",
)
def feat_quantile_bin(spark, d):
    df = table(spark, d, "part")
    specs = [{"op": "quantile_bin", "params": {"col": "p_retailprice", "n_bins": n}} for n in (4, 3)]
    return FeatureTransformer(specs).fit(df.where("p_partkey % 5 <> 0")).transform(df).select("p_partkey", "p_retailprice_bin4", "p_retailprice_bin3")


@query(
    "feat_frequency_encode",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer),
    t AS (SELECT * FROM c WHERE c_custkey % 5 <> 0 AND coalesce(seg, '') <> 'MACHINERY'), n AS (SELECT count(*) AS n FROM t), f AS (SELECT seg, count(*) AS k FROM t WHERE seg IS NOT NULL GROUP BY seg)
    SELECT c_custkey, CASE WHEN c.seg IS NOT NULL THEN coalesce(CAST(k AS DOUBLE) / n, 0) END AS seg_freq FROM c LEFT JOIN f ON c.seg = f.seg, n""",
)
def feat_frequency_encode(spark, d):
    """A segment that training never saw, and null keys."""
    df = table(spark, d, "customer").withColumn("seg", F.expr("CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END"))
    model = FeatureTransformer([{"op": "frequency_encode", "params": {"col": "seg"}}]).fit(df.where("c_custkey % 5 <> 0 AND coalesce(seg, '') <> 'MACHINERY'"))
    return model.transform(df).select("c_custkey", "seg_freq")


@query(
    "feat_target_encode",
    """WITH t AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0 AND c_mktsegment <> 'BUILDING'), g AS (SELECT avg(c_acctbal) AS g FROM t), m AS (SELECT c_mktsegment AS s, count(*) AS n, avg(c_acctbal) AS m FROM t GROUP BY 1)
    SELECT c_custkey, round(coalesce((n * m + 10 * g) / (n + 10), g), 6) AS c_mktsegment_target_enc FROM customer LEFT JOIN m ON c_mktsegment = s, g""",
)
def feat_target_encode(spark, d):
    df = table(spark, d, "customer")
    model = FeatureTransformer([{"op": "target_encode", "params": {"col": "c_mktsegment", "smoothing": 10.0}}], "c_acctbal").fit(df.where("c_custkey % 5 <> 0 AND c_mktsegment <> 'BUILDING'"))
    return model.transform(df).select("c_custkey", F.round("c_mktsegment_target_enc", 6).alias("c_mktsegment_target_enc"))


GROUPED_SQL = {"mean": "avg(c_acctbal)", "median": "median(c_acctbal)", "std": "stddev_samp(c_acctbal)", "max": "max(c_acctbal)", "min": "min(c_acctbal)"}


def _grouped(agg: str):
    sql = f"""WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey = 1 THEN 99 WHEN c_nationkey = 7 THEN NULL ELSE c_nationkey END AS k FROM customer),
    t AS (SELECT * FROM c WHERE c_custkey % 5 <> 0 AND coalesce(k, 0) <> 3), g AS (SELECT {GROUPED_SQL[agg]} AS g FROM t), m AS (SELECT k, true AS hit, {GROUPED_SQL[agg]} AS m FROM t WHERE k IS NOT NULL GROUP BY k)
    SELECT c_custkey, round(CASE WHEN c.k IS NOT NULL THEN CASE WHEN hit THEN m ELSE g END END, 6) AS v FROM c LEFT JOIN m ON c.k = m.k, g"""

    @query(f"feat_group_agg_{agg}", sql)
    def run(spark, d):
        """A group of one row, a group that training never saw, and null keys."""
        df = table(spark, d, "customer").withColumn("k", F.expr("CASE WHEN c_custkey = 1 THEN 99 WHEN c_nationkey = 7 THEN NULL ELSE c_nationkey END"))
        model = FeatureTransformer([{"op": "group_aggregate", "params": {"by": "k", "col": "c_acctbal", "agg": agg}}]).fit(df.where("c_custkey % 5 <> 0 AND coalesce(k, 0) <> 3"))
        return model.transform(df).select("c_custkey", F.round(f"c_acctbal_{agg}_by_k", 6).alias("v"))


for _agg in GROUPED_SQL:
    _grouped(_agg)

ALL = [
    {"op": "log1p", "params": {"col": "l_extendedprice"}},
    {"op": "ratio", "params": {"a": "l_extendedprice", "b": "l_quantity"}},
    {"op": "product", "params": {"a": "l_extendedprice", "b": "l_discount"}},
    {"op": "datetime_parts", "params": {"col": "l_shipdate"}},
    {"op": "winsorize", "params": {"col": "l_quantity"}},
    {"op": "quantile_bin", "params": {"col": "l_extendedprice", "n_bins": 4}},
    {"op": "frequency_encode", "params": {"col": "l_returnflag"}},
    {"op": "target_encode", "params": {"col": "l_linestatus", "smoothing": 10.0}},
    {"op": "group_aggregate", "params": {"by": "l_returnflag", "col": "l_extendedprice", "agg": "mean"}},
]


@query(
    "feat_all",
    f"""WITH t AS (SELECT * FROM lineitem WHERE l_orderkey % 5 <> 0),
    s AS (SELECT quantile_cont(l_quantity, 0.01) AS lo, quantile_cont(l_quantity, 0.99) AS hi, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS e, count(*) AS n, avg(l_tax) AS g, avg(l_extendedprice) AS ge FROM t),
    f AS (SELECT l_returnflag AS rf, count(*) AS k, avg(l_extendedprice) AS m FROM t GROUP BY 1), y AS (SELECT l_linestatus AS ls, count(*) AS k, avg(l_tax) AS m FROM t GROUP BY 1)
    SELECT {LINE_SQL}, round(ln(1 + greatest(l_extendedprice, 0)), 6) AS l_extendedprice_log1p, l_extendedprice / nullif(l_quantity, 0) AS l_extendedprice_ratio_l_quantity, l_extendedprice * l_discount AS l_extendedprice_x_l_discount,
    CAST(isodow(l_shipdate) - 1 AS DOUBLE) AS l_shipdate_dayofweek, CAST(month(l_shipdate) AS DOUBLE) AS l_shipdate_month, CAST(isodow(l_shipdate) >= 6 AS DOUBLE) AS l_shipdate_is_weekend,
    least(greatest(l_quantity, lo), hi) AS l_quantity_winsor, CAST(len(list_filter(e, lambda x: x <= l_extendedprice)) AS DOUBLE) AS l_extendedprice_bin4,
    coalesce(CAST(f.k AS DOUBLE) / n, 0) AS l_returnflag_freq, round(coalesce((y.k * y.m + 10 * g) / (y.k + 10), g), 6) AS l_linestatus_target_enc, round(coalesce(f.m, ge), 4) AS l_extendedprice_mean_by_l_returnflag
    FROM lineitem LEFT JOIN f ON l_returnflag = rf LEFT JOIN y ON l_linestatus = ls, s WHERE l_orderkey % 5 = 0""",
)
def feat_all(spark, d):
    df = table(spark, d, "lineitem")
    return _all_columns(FeatureTransformer(ALL, "l_tax").fit(df.where("l_orderkey % 5 <> 0")).transform(df.where("l_orderkey % 5 = 0")), df.columns)


def _all_columns(out, raw):
    made = [c for c in out.columns if c not in raw]
    exact = {"l_extendedprice_log1p": 6, "l_linestatus_target_enc": 6, "l_extendedprice_mean_by_l_returnflag": 4}
    return out.select(*LINE, *[F.round(c, exact[c]).alias(c) if c in exact else F.col(c) for c in made])


@query("feat_saved", ORACLES["feat_all"])
def feat_saved(spark, d):
    """All operations fitted, saved, loaded and replayed."""
    df = table(spark, d, "lineitem")
    path = persist.new_folder(spark, "features")
    FeatureTransformer(ALL, "l_tax").fit(df.where("l_orderkey % 5 <> 0")).save(path)
    return _all_columns(persist.load(spark, path).transform(df.where("l_orderkey % 5 = 0")), df.columns)


@query(
    "feat_ordered_target",
    f"""WITH r AS (SELECT {LINE_SQL}, coalesce(l_returnflag, 'MISSING') AS c, (l_quantity > 25)::INT AS y, md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS h FROM lineitem),
    m AS (SELECT avg(y) AS prior FROM r)
    SELECT {LINE_SQL}, round((sum(y) OVER w - sum(y) OVER p + prior) / (count(*) OVER w - count(*) OVER p + 1), 9) AS l_returnflag_ordered FROM r, m
    WINDOW w AS (PARTITION BY c ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY c, h)""",
)
def feat_ordered_target(spark, d):
    """Target means over the rows before each one in a permutation that SQL can draw too."""
    df = table(spark, d, "lineitem").withColumn("y", (F.col("l_quantity") > 25).cast("int"))
    out = ordered_target(df, ["l_returnflag"], "y", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.select(*LINE, F.round("l_returnflag_ordered", 9).alias("l_returnflag_ordered"))


@query("feat_expressions", f"SELECT {LINE_SQL}, l_extendedprice * (1 - l_discount) / greatest(l_quantity, 1) AS unit, CASE WHEN l_tax > 0.04 THEN l_tax ELSE l_discount END AS higher FROM lineitem")
def feat_expressions(spark, d):
    """Columns from texts; the two that must be refused are not among them."""
    texts = {"unit": "l_extendedprice * (1 - l_discount) / greatest(l_quantity, 1)", "higher": "CASE WHEN l_tax > 0.04D THEN l_tax ELSE l_discount END", "leak": "l_returnflag", "drawn": "rand() * l_tax"}
    out, _ = add_columns(table(spark, d, "lineitem"), texts, target="l_returnflag")
    return out.select(*LINE, *[c for c in texts if c in out.columns])
