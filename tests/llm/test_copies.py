"""Near duplicates, repeated strings and contamination: exact against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lumen.llm import components, decontamination, jaccard_join, suffix_dedup

from ..oracle import connect, same
from .util import odd_documents, prose, words


def brute_join(docs, n=5, threshold=0.8):
    sets = []
    for _, text in docs:
        w = words(text)
        k = min(n, len(w))
        sets.append({(k, *w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [docs[i][0] for i in members if docs[i][0] is not None]
        out += [(docs[i][0], min(ids) if ids else None, links[i], len(members)) for i in members]
    return sorted(out, key=str)


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}z"
    return " ".join(w)


@pytest.mark.parametrize("block", [1536, 4])
def test_join_finds_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(4)
    docs = odd_documents(rng)
    for g in range(12):
        base = prose(rng, rng.randrange(6, 200), 10**6)
        docs += [(100 + 20 * g + i, edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.04]))) for i in range(rng.randrange(2, 14))]
    docs += [(900, "two words"), (901, "two words"), (902, "Two  WORDS!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in jaccard_join.join(df).collect()), key=str)
    assert got == brute_join(docs)


def test_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(df).count() == 0


def test_keep_one_leaves_one_of_each(spark):
    rng = random.Random(6)
    base = prose(rng, 80, 10**6)
    docs = [(5, base), (3, base), (3, base), (8, edited(rng, base, 0.01)), (9, prose(rng, 50, 10**6)), (10, None), (11, None)]
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], "doc_id long, text string, source string, ck int, root int")
    out = jaccard_join.keep_one(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [3, 9, 10, 11]


def test_ids_with_several_texts(spark):
    rng = random.Random(9)
    a, b = prose(rng, 80, 10**6), prose(rng, 70, 10**6)
    near = edited(rng, a, 0.01)
    docs = [(1, a, "x"), (5, near, "x"), (5, b, "y"), (5, b, "z"), (7, near, "x"), (None, near, "n"), (None, "of its own kind", "n"), (9, None, "q"), (9, None, "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, keep_id string")
    got = sorted(((r[0], r[1]) for r in jaccard_join.keep_one(df).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (None, "of its own kind"), (9, None), (9, None)], key=str)
    # a class of null ids only keeps one text
    none = spark.createDataFrame([(None, a), (None, near), (None, a)], "doc_id long, text string")
    assert jaccard_join.keep_one(none).count() == 1


def test_depths_reach_the_recall():
    least = jaccard_join.least_depth()
    assert jaccard_join.meeting(0.8, least) >= jaccard_join.TARGET_RECALL > jaccard_join.meeting(0.8, least + 1)
    none, high, low = np.zeros(20), np.zeros(20), np.zeros(20)
    high[15:], low[0] = 1e7, 1e7
    go = lambda found: jaccard_join.next_depth(found, 8, least, 0.8)
    # nothing found proves nothing; links far above the threshold are all found by whole labels; links at it need the least depth
    assert (go(none), go(high), go(low)) == (least, 8, least)
    assert least < jaccard_join.next_depth(high + low / 1e2, 8, least, 0.8) < 8


def test_unlinked_texts_are_verified_by_node(spark):
    """Texts that share a fifth of their shingles chain nodes together; the pairs verified are at most those that the nodes propose."""
    rng = random.Random(12)
    common = prose(rng, 60, 10**6)
    docs = [(i, f"{common} {prose(rng, 90, 10**6)}") for i in range(3000)]
    seen: dict = {}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sigs, final = jaccard_join.classes(df, report=seen)
    assert final.count() == 0 and seen["depths"][-1] == jaccard_join.least_depth()
    assert 0 < seen["verified"] <= seen["proposed"] < 3000 * 2999 / 2 / 4


def test_recall_near_the_threshold(spark):
    rng = random.Random(13)
    docs = []
    for g in range(150):
        base = prose(rng, 200, 10**6)
        docs += [(2 * g, base), (2 * g + 1, edited(rng, base, rng.choice([0.005, 0.01, 0.02])))]
    want = sum(r[2] for r in brute_join(docs))
    got = sum(r["n_links"] for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert 0.99 * want <= got <= want and want > 150


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((top(a), top(b)))
        parent[rb] = ra
    want = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removal(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_repeated_strings(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(8)
    passage = prose(rng, 60, 10**5)
    docs = [(i, t) for i, (_, t) in enumerate(odd_documents(rng)) if i != 5]
    docs += [(50 + i, f"{prose(rng, 40, 10**5)} {passage[: rng.randrange(150, 360)]} {prose(rng, 20, 10**5)}") for i in range(12)]
    docs += [(80, "ha " * 300), (81, passage[:200]), (82, passage[1:201]), (83, passage[:199] + "é"), (84, "x" * 199), (85, "y" * 201), (86, passage + " " + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove(df).collect()}
    want = dict(zip([d[0] for d in docs], brute_removal([d[1] for d in docs]), strict=True))
    assert got == want


def test_repeated_rows_and_null_ids(spark):
    text = prose(random.Random(3), 50)
    docs = [(1, text), (1, text), (None, text), (2, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = [tuple(r)[1:4] for r in suffix_dedup.remove(df).collect()]
    assert sorted(out) == [(0, 0, 0)] + [(len(text), len(text), 1)] * 3
    assert suffix_dedup.remove(df.limit(0)).count() == 0


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(5)
    a = prose(rng, 100, 10**5).encode()
    b = prose(rng, 30, 10**5).encode() + a + b"tail" * 60
    place = {}
    for data in (a, b):
        for lo, hi, at, h in zip(*suffix_dedup.anchors(data), strict=True):
            for p in range(lo, hi + 1):
                s = data[p : p + 200]
                assert place.setdefault(s, (at - p, h)) == (at - p, h)


def brute_scan(docs, items, n=13):
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1):
            if k:
                wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found |= wins[tuple(w[i : i + k])]
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [500_000, 0])
def test_contamination(spark, monkeypatch, few):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", few)
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randrange(1, 60), 300)) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "Only THREE words")]
    docs = odd_documents(rng)
    for i in range(25):
        _, item = rng.choice(items[:12])
        docs.append((200 + i, f"{prose(rng, rng.randrange(0, 300), 300)} {item.upper() if i % 2 else item} {prose(rng, 20, 300)}"))
    docs += [(300, "we say only, three: words"), (301, "É " + " ".join(["only three words"] * 3))]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, h int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.scan(df, b).collect()), key=str)
    assert got == brute_scan(docs, items)
    kept = decontamination.drop_contaminated(df, b)
    assert kept.columns == df.columns and kept.count() == sum(not r[4] for r in got)
    assert decontamination.scan(df, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.scan(df.limit(0), b).count() == 0


def test_spans_are_cut_out(spark):
    item = " ".join(f"b{i}" for i in range(13))
    df = spark.createDataFrame([(1, f"Keep this. {item.upper()}; and that!"), (2, "nothing here")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert words(out[1]) == ["keep", "this", "and", "that"] and out[1].startswith("Keep this.") and out[2] == "nothing here"


def test_contamination_agrees_with_sql(spark, sf_dir):
    same(decontamination.query(spark, sf_dir), connect(sf_dir), decontamination.oracle())


def test_sieve_holds_every_key(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lumen.llm import common

    rows = spark.range(4000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    for most in (common.SIEVE_BITS, 256):
        monkeypatch.setattr(common, "SIEVE_BITS", most)
        bits, caught = common.sieve(rows.where("k is null or k % 40 = 0"), F.xxhash64("k"), F.xxhash64("k"))
        held = rows.join(bits, caught, "left_semi")
        assert held.where("k is null or k % 40 = 0").count() == 100 and rows.join(bits, caught, "left_anti").count() == 4000 - held.count()
        assert held.count() < (600 if most > 256 else 2500)
    none, caught = common.sieve(rows.limit(0), F.xxhash64("k"), F.xxhash64("k"))
    assert rows.join(none, caught, "left_semi").count() == 0


def test_sets_go_only_to_nodes_with_similar_labels(spark, monkeypatch):
    """Of texts that share a fifth of their shingles, and so many short prefixes, no set is sent to a task."""
    sent = []
    verify = jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda rows, *a: sent.append(rows.count()) or verify(rows, *a))
    common = " ".join(f"c{i}" for i in range(14))
    df = spark.createDataFrame([(i, common + " " + " ".join(f"w{i}_{j}" for j in range(32))) for i in range(1500)], "doc_id long, text string")
    seen: dict = {}
    _, final = jaccard_join.classes(df, report=seen)
    assert final.count() == 0 and seen["verified"] > 0 and sum(sent) == 0
    assert jaccard_join.least_matches(0.8, 192) == 111 and jaccard_join.least_matches(0.8, 8) == 0
