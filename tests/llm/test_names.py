"""Tables with columns named like an operator's own, and empty ones."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lumen.llm import quality, suffix_dedup, topk

from .util import odd_documents, prose


def _rows(df):
    return sorted(map(str, df.collect()))


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)] + [(7, None), (None, [0.5, None, 0.0, 0.0])]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = plain.withColumns({c: F.lit("x") for c in ("_id", "_v", "_row", "_q", "_h", "_g", "_db", "_qb", "qrow", "score", "rank", "query_id")})
    ask = lambda df: topk.search(df, lambda i: i % 10 == 0)
    assert _rows(ask(odd)) == _rows(ask(plain)) and ask(odd).count() == 60
    assert ask(odd.limit(0)).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(2)
    shared = prose(rng, 80)
    docs = [(i, f"{prose(rng, 30)} {shared if i % 2 else ''} {prose(rng, 30)}") for i in range(12)] + [(None, shared), (3, None)]
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    odd = plain.withColumns({c: F.lit(1) for c in ("dk", "data", "key", "h", "sid", "part", "kept", "n_bytes")})
    assert _rows(suffix_dedup.remove(odd)) == _rows(suffix_dedup.remove(plain))
    assert suffix_dedup.remove(odd.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(3)
    docs = [(i, t, "en", "web", len(t or "")) for i, t in odd_documents(rng)] + [(100 + i, prose(rng, 40), "en", "web", 5) for i in range(40)]
    plain = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    odd = plain.withColumns({c: F.lit(1) for c in ("_mv", "_fold", "_text", "_y", "_lid", "score", "keep", "quality")})
    got, want = ({str((r["doc_id"], round(r["score"], 6))) for r in quality.score(d, labels).collect()} for d in (odd, plain))
    assert got == want and quality.score(odd.limit(0), labels).count() == 0
