"""Merkle manifest: laws of the monoid, and trees against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from lumen.llm import manifest

from ..oracle import connect, same
from .util import UPPER, odd_documents

A = manifest.ARITY


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """root, and for each node the siblings on its way up: a list of (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run, k = nodes[i // A * A : i // A * A + A], i % A
            paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes = [h(*nodes[i : i + A]) for i in range(0, len(nodes), A)]
        at = [i // A for i in at]
    return nodes[0], paths


def fields(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows, tree, key):
    """Sorted (key, leaf, subroot, root, proof) of all rows, columns by place."""
    groups = {}
    for r in rows:
        groups.setdefault(r[tree], []).append((r[key] is not None, r[key] if r[key] is not None else 0, fields(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, own = [], []
    for g in order:
        leaves = sorted(groups[g], key=lambda x: x[:3])
        sub, paths = climb([x[2] for x in leaves])
        subs.append(sub)
        own.append([(x[3][key], x[2], sub, p) for x, p in zip(leaves, paths, strict=True)])
    root, above = climb(subs)
    return [(k, leaf, sub, root, p + up) for part, up in zip(own, above, strict=True) for k, leaf, sub, p in part]


def test_monoid_laws():
    rng = random.Random(4)
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 513, 1000):
        leaves = {(0, i): h(str(i)) for i in range(n)}
        cuts = sorted(rng.sample(range(n + 1), min(n + 1, 5)))
        parts = [{k: v for k, v in leaves.items() if a <= k[1] < b} for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        lifted = [manifest.merge(p, n=n)[0] for p in parts]
        rng.shuffle(lifted)
        left = {}
        for p in lifted:
            left = manifest.merge(left, p, n=n)[0]
        right = {}
        for p in reversed(lifted):
            right = manifest.merge(p, right, n=n)[0]
        top = {(len(manifest.sizes(n)) - 1, 0): climb(list(leaves.values()))[0]}
        assert left == right == manifest.merge(*lifted, n=n)[0] == top
        for p in lifted:
            assert manifest.merge(p, {}, n=n) == (p, {})
            per = [sum(1 for level, _ in p if level == x) for x in range(5)]
            assert max(per) <= 2 * (A - 1)


def check(spark, rows, schema, tree, key, parts=None):
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame(rows, schema)
    out = manifest.manifest(df, names, tree, key).withColumn("again", manifest.fold(F.col("leaf"), F.col("proof")))
    got = [(r[key], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in out.collect()]
    assert all(r["again"] == r["root"] for r in out.collect())
    by = lambda x: (x[0] is not None, x[0] or 0, x[1], x[4])
    assert sorted(got, key=by) == sorted(brute(rows, names.index(tree), names.index(key)), key=by)


def test_odd_rows_and_clashing_names(spark):
    rng = random.Random(5)
    rows = [(i, t, rng.choice([None, "", "de", "é", "z"]), None if n % 3 else n) for n, (i, t) in enumerate(odd_documents(rng))]
    rows += [rows[1]] * 20 + [(None, None, None, None)] * 3
    check(spark, rows, "doc_id long, text string, level string, part long", "level", "doc_id")
    check(spark, rows[:1], "doc_id long, text string, level string, part long", "level", "doc_id")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert manifest.manifest(empty, ["doc_id", "text"], "lang", "doc_id").count() == 0


def test_trees_higher_than_a_unit(spark):
    """Several units, parts and rounds; one tree holds most rows."""
    n = A**manifest.UNIT + 700
    rows = [(i, "a" if i % 50 else "b", str(i * 7)) for i in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", str(manifest.FAN + 3))
    try:
        check(spark, rows, "k long, g string, v string", "g", "k")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_query(spark, sf_dir):
    same(manifest.query(spark, sf_dir), connect(sf_dir), manifest.oracle())
    rows = manifest.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect()
    for r in rows:
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and (r["text"] or "").translate(UPPER) != (r["text"] or "")
        assert r["verified"] == (r["folded_root"] == r["root"]) == (not tampered)
