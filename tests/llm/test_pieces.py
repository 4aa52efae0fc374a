"""Packing, sharding and top-k: exact against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumen.llm import packing, sharding, topk

from ..oracle import connect, same
from .util import odd_documents


def test_cuts():
    for n in range(1, 5000, 7):
        c = packing.cuts(n)
        assert sum(c) == n and all(x & (x - 1) == 0 and x <= 1024 for x in c) and c == sorted(c, reverse=True)
        assert max(Counter(x for x in c if x < 1024).values(), default=1) == 1


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    docs = [d for d in odd_documents(random.Random(1)) if d[0] is not None] + [(20, "a <|endoftext|> b")]
    docs = list({d[0]: d for d in docs}.values())
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, sequence_id string")
    rows = packing.pack(df, ids=True).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    for doc_id, text in docs:
        got = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        want = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert [i for r in got for i in r["ids"]] == want
        assert [r["start"] for r in got] == [sum(x["length"] for x in got[:k]) for k in range(len(got))]
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["doc_tokens"] == len(want) and r["bucket"] == r["length"]
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 1000)


def test_packing_query(spark, sf_dir):
    out = packing.query(spark, sf_dir)
    sums = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(sums) == 200 and all(r["sum(length)"] == r["max(doc_tokens)"] for r in sums)


def test_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(10)]
    t = sharding.lookup_table(names, 997)
    n = np.bincount(t, minlength=10)
    assert n.max() - n.min() <= 1 and n.sum() == 997
    less = sharding.lookup_table(names[:-1], 997)
    moved = np.mean([names[a] != names[b] for a, b in zip(t, less, strict=True) if a != 9])
    assert moved < 0.25
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 997)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_every_slot_goes_to_the_first_claimant():
    """The table filled by the definition, one claim at a time."""
    import hashlib

    names, size = ["x", "y", "z"], 13
    order = []
    for s in names:
        d = hashlib.md5(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:], "big") % (size - 1) + 1
        order.append([(offset + i * skip) % size for i in range(size)])
        assert sorted(order[-1]) == list(range(size))
    owner = {}
    while len(owner) < size:
        for s in range(3):
            if len(owner) < size:
                owner[next(x for x in order[s] if x not in owner)] = s
    assert [owner[i] for i in range(size)] == sharding.lookup_table(names, size).tolist()


def test_sharding_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, shard string")
    out = sharding.place(df, "doc_id").collect()
    assert len(out) == 3 and out[0]["slot"] == out[1]["slot"] and all(r["shard"] for r in out)
    assert sharding.place(df.limit(0), "doc_id").count() == 0


def test_sharding_agrees_with_sql(spark, sf_dir):
    same(sharding.query(spark, sf_dir), connect(sf_dir), sharding.oracle())


def brute_topk(rows, is_query, k=5):
    out = []
    x = [np.floor(256 * np.array(v, np.float64)).astype(np.int64) for _, v in rows]
    for i, (qid, _) in enumerate(rows):
        if qid is not None and is_query(qid):
            s = sorted((-int(x[i] @ x[j]), jid if jid is not None else 1 << 62) for j, (jid, _) in enumerate(rows) if j != i)[:k]
            out += [(qid, r + 1, None if j == 1 << 62 else j, -v) for r, (v, j) in enumerate(s)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8192, 64])
def test_topk_exact_with_ties_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 16)]) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(40)] + [(400, [0.0] * 16), (None, [0.1] * 16)]
    odd = [(501, None), (502, [None] * 16), (503, [float("nan")] * 16), (504, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((tuple(r) for r in topk.search(df, lambda i: i % 50 == 0).collect()), key=str)
    assert got == brute_topk(rows, lambda i: i % 50 == 0)
    assert topk.search(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_topk_of_few_and_of_large_components(spark):
    df = spark.createDataFrame([(0, [1e6, -3.0]), (1, [2e6, 5.0]), (2, [-1e6, 1.0])], "vec_id long, embedding array<double>")
    rows = [(0, [1e6, -3.0]), (1, [2e6, 5.0]), (2, [-1e6, 1.0])]
    assert sorted((tuple(r) for r in topk.search(df, lambda i: i == 0).collect()), key=str) == brute_topk(rows, lambda i: i == 0)


def test_proof_keeps_every_member():
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(0, 0.125, (3000, 64)))
    q = x[:40]
    qi, xi = topk.possible(q, x, np.arange(40))
    exact = q @ x.T
    exact[np.arange(40), np.arange(40)] = -np.inf
    for i in range(40):
        assert set(np.argsort(-exact[i], kind="stable")[:5]) <= set(xi[qi == i])
    assert len(qi) < 0.2 * 40 * 3000


def test_topk_agrees_with_sql(spark, sf_dir):
    same(topk.query(spark, sf_dir), connect(sf_dir), topk.oracle())


def test_integers_fill_short_rows():
    assert topk.integers(pa.array([[0.5], [], [0.25, -0.1]], pa.list_(pa.float64()))).tolist() == [[128, 0], [0, 0], [64, -26]]
