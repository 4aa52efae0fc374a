"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Components are integers, floor(256 x). A block of vectors is indexed by
quantised impact: a posting (dimension, vector) belongs to the segment of its
level, the rounded quotient of its value and the block's step. Segments are
processed by descending level. What they add to the accumulators is the
quantised contribution; what is still unprocessed and the rounding together
bound each score from both sides. Processing stops once the bounds prove that
few vectors can be among the k best (or all segments are processed), and those
possible members are scored exactly. Queries and vectors meet in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 5
SCALE = 256
#: Rows of a block of vectors and of a block of queries; they bound a task's memory.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Levels on either side of zero, and the lowest level of each run of segments between two checks of the proof.
LEVELS, RUNS = 31, (16, 8, 4, 2, 1)
#: Go on while more than so many times k possible members are left for a query.
FEW = 8


def integers(column: pa.Array) -> np.ndarray:
    """Rows of floor(256 x); shorter rows are filled with zeros."""
    n = len(column)
    lengths = np.diff(np.asarray(column.offsets))
    width = int(lengths.max()) if n else 0
    out = np.zeros((n, width))
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    rows = np.repeat(np.arange(n), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.floor(values * SCALE)
    return out


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows."""
    most = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**62:
        q, x = q.astype(np.int64), x.astype(np.int64)
        parts = [np.einsum("ij,ij->i", q[qi[a : a + 65536]], x[xi[a : a + 65536]]) for a in range(0, len(qi), 65536)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)) for i, j in zip(qi, xi, strict=True)], dtype=np.int64)


def possible(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that hold, for each query, all its k best vectors of the block; never a query's own row (`own`: its place in the block, or -1)."""
    m, n = len(q), len(x)
    mine = np.flatnonzero(own >= 0)
    if n <= k * FEW:
        free = np.ones((m, n), bool)
        free[mine, own[mine]] = False
        return np.nonzero(free)
    top = np.abs(x).max(initial=0)
    step = max(1.0, np.ceil(top / LEVELS))
    level = np.rint(x / step)
    size = np.abs(level)
    kind = np.float32 if max(1, x.shape[1]) * max(1.0, np.abs(q).max(initial=0)) * (top + step) < 2**24 else np.float64
    qs, qa = q.astype(kind), np.abs(q).astype(kind)
    total = qa.sum(axis=1, keepdims=True)
    acc, seen = np.zeros((m, n), kind), np.zeros((m, n), kind)
    above = LEVELS + 1
    for low in RUNS:
        segment = (size >= low) & (size < above)
        if segment.any():
            acc += qs @ np.where(segment, level * step, 0).astype(kind).T
            seen += qa @ segment.astype(kind).T
        above = low
        # rounding: half a step a posting; unprocessed postings: below (low - 1/2) steps
        slack = total * (step / 2) + (total - seen) * ((low - 1) * step)
        lower = acc - slack
        lower[mine, own[mine]] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k]
        member = acc + slack >= bar[:, None]
        member[mine, own[mine]] = False
        if np.count_nonzero(member) <= FEW * k * m:
            break
    return np.nonzero(member)


def best(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each query, ties to the smaller id: query, vector, score."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (q, x))
    qi, xi = possible(q, x, own, k)
    score = _exact(q, x, qi, xi)
    order = np.lexsort((ids[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    first = np.r_[True, qi[1:] != qi[:-1]] if len(qi) else np.zeros(0, bool)
    rank = np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0))
    keep = rank < k
    return qi[keep], xi[keep], score[keep]


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products with every row but its own.

    Vectors that are null or hold a null or non-finite component take no part.
    Fewer than k candidates: all. Ties go to the smaller id (null ids last). A
    repeated row is a candidate like any other; a query row excludes itself
    only. Rows of unequal length are filled with zeros. Scores must fit a long.
    Vectors and queries are dealt into blocks by row, not by value, so equal
    vectors spread evenly; a block pair is one task's work. An empty table gives
    none. Only the two named columns are read, so others may have any name.
    """
    from .common import cut

    x = F.col("_v")
    finite = F.forall("_v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).where(x.isNotNull() & finite)
    rows = cut(rows.withColumns({"_row": F.monotonically_increasing_id(), "_q": F.coalesce(is_query(F.col("_id")), F.lit(False))}), "topk-rows")
    n, m = rows.agg(F.count("*"), F.count_if("_q")).first()
    nb, nq = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    place = rows.withColumns({"_h": F.pmod(F.xxhash64("_row"), F.lit(nb)), "_g": F.pmod(F.xxhash64("_row", F.lit(1)), F.lit(nq))})
    span = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
    # both sides come from one table: each gets attributes of its own, or pruning takes one side's for the other's
    own = lambda *names: [F.col(c).alias(c) for c in names]
    data = place.select(*own("_row", "_id", "_v"), F.col("_h").alias("_db"), span(nq).alias("_qb"))
    asked = place.where("_q").select(*own("_row", "_id", "_v"), F.col("_g").alias("_qb"), span(nb).alias("_db"))
    schema = pa.schema([("qrow", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        q, v = (integers(t["_v"].chunk(0)) for t in (left, right))
        qrow, vrow = left["_row"].to_numpy(), right["_row"].to_numpy()
        order = np.argsort(vrow)
        at = np.minimum(np.searchsorted(vrow, qrow, sorter=order), len(vrow) - 1)
        own = np.where(vrow[order[at]] == qrow, order[at], -1)
        ids = right["_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        qi, xi, score = best(q, v, own, ids, k)
        return pa.table([pa.array(qrow[qi]), left["_id"].combine_chunks().take(pa.array(qi)), right["_id"].combine_chunks().take(pa.array(xi)), pa.array(score)], schema=schema)

    found = asked.groupBy("_qb", "_db").cogroup(data.groupBy("_qb", "_db")).applyInArrow(run, "qrow long, query_id long, vec_id long, score long")
    # k rows from each block: few for one query, whatever the number of rows
    from pyspark.sql import Window

    order = Window.partitionBy("qrow").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return search(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle() -> str:
    return ORACLE
