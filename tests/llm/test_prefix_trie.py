"""The trie of conversations against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from lumen.llm import prefix_trie

from ..oracle import connect, same

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs: dict):
    """conv id -> list of (role, text): sorted rows of COLUMNS."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        return [node, *(x for c in children.get(node, []) for x in below(c))]

    out = []
    for node, ids in members.items():
        tree = below(node)
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in tree if u)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children.get(node, [])), sum(1 for u in tree if u not in children), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, convs: dict):
    """conv id -> turns; conversations without turns are added as such."""
    rows = [(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)]
    random.Random(1).shuffle(rows)
    df = prefix_trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    empty = spark.createDataFrame([(c, []) for c, ts in convs.items() if not ts], df.schema)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df.unionByName(empty)).collect()), key=str)
    assert got == brute(convs)


@pytest.fixture
def partitions(spark):
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed, n, letters, longest, parts", [(1, 60, 2, 7, 13), (2, 150, 3, 5, 29), (3, 40, 1, 30, 7), (4, 90, 2, 3, 90), (5, 25, 6, 4, 1)])
def test_random_tries(spark, partitions, seed, n, letters, longest, parts):
    """Runs that reach over many partitions, copies, prefixes of others, empty conversations."""
    rng = random.Random(seed)
    partitions(parts)
    convs = {rng.randrange(-50, 10**6): [(rng.choice("ab"[: 1 + letters // 3]), "é" * rng.randrange(letters)) for _ in range(rng.randrange(longest + 1))] for _ in range(n)}
    convs |= {-1000 - i: list(next(iter(convs.values()))) for i in range(n // 3)}
    check(spark, convs)


def test_shapes(spark, partitions):
    partitions(5)
    check(spark, {7: []})
    check(spark, {7: [], 9: [], 8: [("", "x")]})
    check(spark, {3: [("u", "a"), ("v", "b")]})
    check(spark, {i: [("u", str(i))] for i in range(12)})
    check(spark, {i: [("u", "s")] * i for i in range(1, 40)})
    check(spark, {i: [("u", "s")] * 30 + [("u", str(i % 4))] * 25 for i in range(30)})


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None, None, None, 5), (1, 0, "u", "a", 5), (1, 0, "u", "a", 5), (2, 3, "", "", 5), (2, 9, "u", "a", 5), (None, 1, "u", "a", 5), (3, 1, "u", "x" * 200_000, 5)]
    df = spark.createDataFrame(rows, "id long, n long, who string, turns string, t int")
    seq = prefix_trie.sequences(df, "id", "n", "who", "turns")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(seq).collect()), key=str)
    assert got == brute({1: [("", ""), ("u", "a"), ("u", "a")], 2: [("", ""), ("u", "a")], 3: [("u", "x" * 200_000)]})
    assert prefix_trie.trie(seq.limit(0)).count() == 0


def test_many_copies_are_hashed_in_order(spark):
    n = prefix_trie.CHUNK * 3 + 5
    check(spark, {i * 7 % 1009: [("u", "same")] for i in range(n)} | {5000: [("u", "same"), ("u", "more")]})


def test_query(spark, sf_dir):
    same(prefix_trie.query(spark, sf_dir), connect(sf_dir), prefix_trie.oracle())
