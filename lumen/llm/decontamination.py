"""Benchmark decontamination with a broadcast hash set of test n-grams.

Texts are lower-cased in A-Z and split into words of digits, letters and
non-ASCII characters. A window is `n` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window. Every window of a training
document is looked up by hash in the benchmark's windows and verified by its
words. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_names

N_WORDS = 13
#: A document is contaminated if at least one of so many of its words is hit.
ONE_IN = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The windows are broadcast up to this many; beyond, Spark shuffles both sides.
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    """Normalised words; none for null. For a text of ASCII alone, lower() does the same as translate() and is faster."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), 0), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """Distinct benchmark windows: _h, _len, _words, _items (the ids, as text, of the items that hold it)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("_item"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    items = items.withColumn("_len", F.least(F.size("_w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("_w") - F.col("_len") + 1)
    rows = items.select("_item", "_w", "_len", F.explode(starts).alias("_i")).select("_item", "_len", F.slice("_w", F.col("_i"), F.col("_len")).alias("_words"))
    return (
        rows.groupBy("_words", "_len").agg(F.collect_set(F.coalesce("_item", F.lit(""))).alias("_items"))
        .select(F.xxhash64("_words", "_len").alias("_h"), "_len", "_words", "_items")
    )


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: doc_id, `keep`, n_words, n_hit, spans (0-based start and end word of each hit run), items, contaminated.

    A word inside any occurrence of a window is hit. Null and empty texts have
    no words and are clean; repeated rows each get their row; null ids are kept;
    an empty benchmark hits nothing. Items without words have no window. The
    benchmark's windows are broadcast if they are at most BROADCAST_WINDOWS
    (counted first), else joined by a shuffle. Only the hits and one row per
    document are grouped, by row, so no common passage or source makes a group.
    """
    wins = windows(benchmark, n)
    lengths = sorted(r[0] for r in wins.select("_len").distinct().limit(n).collect())
    few = wins.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    base = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], words(F.col(text_col)).alias("_w")).withColumn("_row", F.monotonically_increasing_id())
    # a window's code is its place (from 1) times n + 1, plus its length; code 0 stands for the document itself, so that documents without a hit stay
    unit, size = n + 1, F.size("_w")
    none = F.array().cast("array<int>")
    codes = [F.when(size >= k, F.sequence(F.lit(unit + k), ((size - (k - 1)) * unit + k).cast("int"), F.lit(unit))).otherwise(none) for k in lengths]
    kept = [f"_keep_{c}" for c in keep]
    place = F.expr(f"_code div {unit}").cast("int").alias("at")
    rows = base.withColumn("_codes", F.concat(F.array(F.lit(0)), *codes)).select("_row", "_id", *kept, "_w", F.explode("_codes").alias("_code")).select("_row", "_id", *kept, "_w", place, (F.col("_code") % unit).alias("len"))
    window = F.slice("_w", F.greatest("at", F.lit(1)), F.greatest("len", F.lit(1)))
    rows = rows.withColumn("h", F.when(F.col("at") > 0, F.xxhash64(F.slice("_w", F.col("at"), F.col("len")), F.col("len")))).withColumn("_n", F.size("_w"))
    side = wins.select("_h", F.col("_len").alias("_wlen"), "_words", "_items")
    if few:
        side = F.broadcast(side)
    else:
        # what is shuffled holds a window's own words, and the other columns once a document
        rows = rows.select("_row", "at", "len", "h", "_n", window.alias("_win"), *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ["_id", *kept]])
        window = F.col("_win")
    joined = rows.join(side, (F.col("h") == F.col("_h")) & (F.col("len") == F.col("_wlen")) & (window == F.col("_words")), "left")
    found = joined.where((F.col("at") == 0) | F.col("_words").isNotNull()).select("_row", "_id", *kept, "_n", F.when(F.col("at") > 0, F.struct((F.col("at") - 1).alias("s"), (F.col("at") - 1 + F.col("len")).alias("e"))).alias("_span"), "_items")
    one = found.groupBy("_row").agg(
        F.first("_id", ignorenulls=True).alias("doc_id"), *[F.first(f"_keep_{c}", ignorenulls=True).alias(c) for c in keep], F.max("_n").cast("long").alias("n_words"),
        F.sort_array(F.collect_set("_span")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("items"),
    )
    # runs: spans sorted by start, joined where they touch
    empty = F.array().cast("array<struct<s:int,e:int>>")
    merged = F.aggregate(
        "_spans", empty,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x))),
    )
    one = one.withColumn("spans", F.when(F.size("_spans") > 0, merged).otherwise(empty))
    one = one.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"]))
    return one.select("doc_id", *keep, "n_words", "n_hit", "spans", "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """`docs` without its contaminated rows; every other row and column unchanged. Columns beside doc_id and text may have any name."""
    cols = docs.columns
    safe, at = plain_names(docs)
    out = scan(safe, benchmark, n, at["doc_id"], at["text"], keep=tuple(safe.columns))
    return out.where(~F.col("contaminated")).select(*safe.columns).toDF(*cols)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """doc_id and `text` without the hit words (what stands between two words stays with the first of them), for callers that cut spans rather than drop documents."""
    found = scan(docs, benchmark, n, keep=("text",))
    between = F.split(F.translate("text", UPPER, LOWER), WORD)
    raw = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)
    hit = lambda i: F.exists("spans", lambda s: (i >= s["s"]) & (i < s["e"]))
    pieces = F.transform(F.col("_raw"), lambda w, i: F.when(hit(i), F.lit("")).otherwise(F.concat(w, F.coalesce(F.get("_gap", i + 1), F.lit("")))))
    cutted = found.withColumns({"_raw": raw, "_gap": between}).withColumn("_text", F.concat(F.coalesce(F.get("_gap", F.lit(0)), F.lit("")), F.array_join(pieces, "")))
    return cutted.select("doc_id", F.when(F.col("n_hit") > 0, F.col("_text")).otherwise(F.col("text")).alias("text"), "n_hit")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len, array_to_string(w[i:i + len - 1], ' ') AS win
       FROM (SELECT item, w, least(len(w), 13) AS len, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM bw),
dw AS (SELECT doc_id, len, i, array_to_string(w[i:i + len - 1], ' ') AS win
       FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM d, lens WHERE len(w) >= len)),
hit AS (SELECT doc_id, i, dw.len, item FROM dw JOIN bw ON dw.win = bw.win AND dw.len = bw.len),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + len)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def oracle() -> str:
    return ORACLE
