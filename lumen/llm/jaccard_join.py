"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

A text is a set of shingles, `n` consecutive words each (words as in
`decontamination`); a text of fewer words is one shingle of all of them. Texts
with equal sets form a class and are compared once. A class has a label of
MAX_DEPTH MinHash symbols in each tree, and a tree is the table of its labels in
sorted order, a prefix trie: a node of depth d is a run of labels with d symbols
in common. Classes that share whole labels with one class have one home, and
their pairs are verified there, if they share any node. Then matched prefixes are
shortened: from the similarities of the links found so far follows how many are
still to be expected at each depth, and the next nodes to look at are the deepest
at which the target recall is reached, until it is. At the least depth used any
pair at the threshold is found with the target probability, whatever was found
before. A node that brings classes of several homes together is a task; a pair is
verified once, on its shingle sets, in the first tree that has it. Labels go to
the tasks first, and the sets follow of those classes only that agree with another
one in as many symbols as nearly any pair at the threshold does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, hot, lookup, plain_names, sieve, tidy
from .components import components

N_WORDS, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH = 24, 8
TARGET_RECALL = 0.99999
#: Probability that a pair at the threshold agrees in fewer symbols than the tasks ask for.
MISSED = 1e-12
#: Classes of a block, of which a task takes two, and shingles that a block may have; classes compared with each other at once.
BLOCK, WEIGHT, STEP = 1536, 1 << 22, 384
#: Places of the histogram of similarities from the threshold to 1.
BINS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def meeting(similarity: np.ndarray | float, d: int, trees: int = TREES) -> np.ndarray | float:
    """Probability that a pair shares a prefix of d symbols in some tree."""
    return 1 - (1 - np.power(similarity, d)) ** trees


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, most: int = MAX_DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which any pair at the threshold meets with the target probability."""
    for d in range(most, 0, -1):
        if meeting(threshold, d, trees) >= target:
            return d
    raise ValueError("more trees are needed for this recall")


def next_depth(found: np.ndarray, at: int, least: int, threshold: float, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """The depth to shorten prefixes to, after `at`; `at` itself if the target recall is reached.

    found: links by similarity, in equal steps from the threshold to 1. A link of
    similarity s stands for 1 / meeting(s) links that exist; one more at the
    threshold is taken to be open, so few links prove nothing.
    """
    s = threshold + (1 - threshold) * np.arange(len(found)) / len(found)
    there = found / meeting(s, at, trees)
    for d in range(at, least, -1):
        open_ = float((there * (1 - meeting(s, d, trees))).sum() + 1 - meeting(threshold, d, trees))
        if open_ <= (1 - target) * (there.sum() + 1):
            return d
    return least


def least_matches(threshold: float, symbols: int, missed: float = MISSED) -> int:
    """The most symbols that a pair at the threshold agrees in but with probability `missed`."""
    below = 0.0
    for m in range(symbols + 1):
        below += math.comb(symbols, m) * threshold**m * (1 - threshold) ** (symbols - m)
        if below > missed:
            return m
    return symbols


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2^64, at least n of them."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, np.uint64(_inverse(int(_BASE))), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    inside = np.concatenate([[False], _IS_WORD[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def shingles(text: str | None, n: int = N_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = _mix(h * _ODD + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated shingle sets of a batch of texts, and the length of each."""
    got = [shingles(t.as_py(), n) for t in texts]
    return (np.concatenate(got) if got else np.zeros(0, np.uint64)), np.array([len(g) for g in got], np.int64)


def _labels(flat: np.ndarray, lengths: np.ndarray, trees: int, most: int) -> np.ndarray:
    """Label of each non-empty set in each tree: `most` MinHash symbols of 16 bits."""
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    out = np.empty((len(starts), trees * most), ">u2")
    salts = np.random.default_rng(7).integers(1, 1 << 32, size=(trees * most, 2), dtype=np.uint32)
    halves = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    for j, (a, b) in enumerate(salts):
        x = (halves[j & 1] ^ a) * (b | np.uint32(1))
        low = np.minimum.reduceat(x ^ (x >> np.uint32(15)), starts)
        out[:, j] = (_mix(low.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def signatures(docs: DataFrame, n: int, trees: int, most: int = MAX_DEPTH) -> DataFrame:
    """doc_id, _t (md5 of the text), ck (hash of the shingle set, null without words), size, label (of all trees)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in _slices(batches):
            flat, lengths = _sets(batch.column(2), n)
            ends = np.cumsum(lengths)
            keys = [hashlib.md5(flat[e - m : e].tobytes()).digest() if m else None for e, m in zip(ends, lengths, strict=True)]
            rows = iter(_labels(flat, lengths, trees, most) if lengths.any() else ())
            labels = [next(rows).tobytes() if m else None for m in lengths]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(lengths), pa.array(labels, pa.binary())], names=["doc_id", "_t", "ck", "size", "label"])

    return docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_t"), "text").mapInArrow(run, "doc_id long, _t string, ck binary, size long, label binary")


def _similar(sizes: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """a x b matrix of exact similarities where `wanted`; what else it holds is of no meaning."""
    out = np.zeros(wanted.shape)
    i, j = np.nonzero(wanted)
    if len(i) <= len(a) + len(b):
        # few pairs: one by one
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = sets[a[x]], sets[b[y]]
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            at = np.searchsorted(q, p)
            common = np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p)
            out[x, y] = common / (len(p) + len(q) - common)
        return out
    used = np.concatenate([a, b]) if a is not b else a
    flat = np.concatenate([sets[i] for i in used])
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    renumbered = np.cumsum(often > 1) - 1
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    shared = often[code] > 1
    row, code = row[shared], renumbered[code[shared]]
    common = np.zeros(wanted.shape, np.float32)
    width, order = 4096, np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    edges = np.searchsorted(code, np.arange(0, (code[-1] + 1 if len(code) else 0) + width, width))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi > lo:
            m = np.zeros((len(used), width), np.float32)
            m[row[lo:hi], code[lo:hi] % width] = 1
            common += m[: len(a)] @ (m[len(a) :] if a is not b else m).T
    common = common.astype(np.float64)
    return common / (sizes[a][:, None] + sizes[b][None, :] - common)


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Enough of the links to connect what they connect: each member of a group with its first one."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = sorted((top(a), top(b)))
        parent[rb] = ra
    return [(x, top(x)) for x in sorted(set(i.tolist()) | set(j.tolist())) if top(x) != x]


def _codes(labels: np.ndarray, d: int) -> np.ndarray:
    """For each tree, a row of numbers that say which node of depth d each member is in."""
    out = np.zeros(labels.shape[:2], np.uint64)
    for k in range(d):
        # up to four symbols fill the number, more are hashed
        out = ((out << np.uint64(16)) if k < 4 else _mix(out) * _ODD) + labels[:, :, k]
    return np.ascontiguousarray(out.T)


def _together(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs that are in one node in some of these trees."""
    out = np.zeros((len(a), len(b)), bool)
    for c in codes:
        out |= c[a][:, None] == c[b][None, :]
    return out


def _wanted(tree: int, labels: np.ndarray, home: np.ndarray, d: int, before: int | None, least: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of some members with others a task takes, as `_verify` says."""
    if tree < 0:
        some = _codes(labels, least)
        return lambda p, q: _together(some, p, q)
    never = _codes(labels[:, :tree], d)
    if before is not None:
        never = np.concatenate([never, _codes(labels, before)])
    return lambda p, q: (home[p][:, None] != home[q][None, :]) & ~_together(never, p, q)


def _steps(side: np.ndarray, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The members to compare at once; the same array twice where they are compared with each other."""
    a = np.arange(len(side)) if one else np.flatnonzero(side == 0)
    b = a if one else np.flatnonzero(side == 1)
    for x in range(0, len(a), STEP):
        for y in range(x if one else 0, len(b), STEP):
            p = a[x : x + STEP]
            q = p if one and x == y else b[y : y + STEP]
            if len(p) and len(q):
                yield p, q


def _screened(rows: DataFrame, d: int, before: int | None, least: int, trees: int, most: int, threshold: float) -> DataFrame:
    """The rows of node tasks (with size and label) whose class agrees, in `least_matches` symbols, with another one that the task would verify it against; and a row a task with a null cid and the number of pairs that it compared."""
    columns = ["g", "tree", "cid", "home", "b", "s", "b2", "s2", "side"]
    enough = least_matches(threshold, trees * most)

    def run(table: pa.Table) -> pa.Table:
        # repeated rows may bring a class more than once
        table = table.take(pa.array(np.unique(table["cid"].to_numpy(), return_index=True)[1]))
        side, home, size = (table[c].to_numpy() for c in ("side", "home", "size"))
        one = table["s"][0].as_py() == table["s2"][0].as_py() and table["b"][0].as_py() == table["b2"][0].as_py()
        flat = np.frombuffer(b"".join(table["label"].to_pylist()), np.uint16).reshape(len(side), trees * most)
        wanted = _wanted(table["tree"][0].as_py(), flat.reshape(len(side), trees, most), home, d, before, least)
        close, pairs = np.zeros(len(side), bool), 0
        for p, q in _steps(side, one):
            takes = wanted(p, q)
            if q is p:
                takes = np.triu(takes, 1)
            pairs += int(np.count_nonzero(takes))
            ratio = size[p][:, None] / size[q][None, :]
            i, j = np.nonzero(takes & (np.minimum(ratio, 1 / ratio) >= threshold))
            for lo in range(0, len(i), 1 << 14):
                x, y = p[i[lo : lo + (1 << 14)]], q[j[lo : lo + (1 << 14)]]
                hit = np.count_nonzero(flat[x] == flat[y], axis=1) >= enough
                close[x[hit]] = close[y[hit]] = True
        kept = table.select(columns).filter(pa.array(close))
        kept = kept.append_column("pairs", pa.array(np.zeros(kept.num_rows, np.int64)))
        return pa.concat_tables([kept, pa.table([pa.array([pairs if f.name == "pairs" else None], f.type) for f in kept.schema], schema=kept.schema)])

    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema), "pairs long"])
    return rows.groupBy("g", "b", "s", "b2", "s2").applyInArrow(run, kinds)


def _verify(rows: DataFrame, d: int, before: int | None, least: int, trees: int, most: int, threshold: float) -> DataFrame:
    """(kind, u, v, w): `e` links that connect what is linked, `l` linked documents of u, `s` links of depth and similarity step u, `n` pairs verified.

    A task of a home (tree -1) takes the pairs that share a node of the least
    depth. A node's task takes those of different homes that share no node of
    depth `d` in an earlier tree, and none of depth `before`, where they were
    verified already.
    """
    schema = pa.schema([("kind", pa.string()), ("u", pa.int64()), ("v", pa.int64()), ("w", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        # repeated rows may bring a class more than once
        table = table.take(pa.array(np.unique(table["cid"].to_numpy(), return_index=True)[1]))
        cid, side, home, weight = (table[c].to_numpy() for c in ("cid", "side", "home", "n_docs"))
        tree = table["tree"][0].as_py()
        one = table["s"][0].as_py() == table["s2"][0].as_py() and table["b"][0].as_py() == table["b2"][0].as_py()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["set"]]
        sizes = np.array([len(x) for x in sets], np.float64)
        labels = np.frombuffer(b"".join(table["label"].to_pylist()), np.uint16).reshape(len(cid), trees, most)
        takes = _wanted(tree, labels, home, d, before, least)
        links, i_all, j_all = np.zeros(len(cid), np.int64), [], []
        seen, pairs = np.zeros((most + 1) * BINS, np.int64), 0
        for p, q in _steps(side, one):
            wanted = takes(p, q)
            if q is p:
                wanted = np.triu(wanted, 1)
            pairs += int(np.count_nonzero(wanted))
            ratio = sizes[p][:, None] / sizes[q][None, :]
            wanted &= np.minimum(ratio, 1 / ratio) >= threshold
            if not wanted.any():
                continue
            similar = _similar(sizes, sets, p, q, wanted)
            hit = wanted & (similar >= threshold)
            links[p] += hit @ weight[q]
            links[q] += hit.T @ weight[p]
            i, j = np.nonzero(hit)
            step = np.minimum(((similar[i, j] - threshold) / (1 - threshold) * BINS).astype(int), BINS - 1)
            i, j = p[i], q[j]
            depth = np.full(len(i), d)
            if tree < 0:
                for k in range(least, most + 1):
                    codes = _codes(labels, k)
                    depth[np.any(codes[:, i] == codes[:, j], axis=0)] = k
            seen += np.bincount(depth * BINS + step, minlength=len(seen))
            i_all.append(i)
            j_all.append(j)
        edges = np.array(_stars(np.concatenate(i_all), np.concatenate(j_all), len(side)) if i_all else [], np.int64).reshape(-1, 2)
        linked, steps = np.flatnonzero(links), np.flatnonzero(seen)
        none = lambda n: np.zeros(n, np.int64)
        parts = [("e", cid[edges[:, 0]], cid[edges[:, 1]], none(len(edges))), ("l", cid[linked], none(len(linked)), links[linked]), ("s", steps, none(len(steps)), seen[steps]), ("n", none(1), none(1), np.array([pairs]))]
        return pa.concat_tables([pa.table([pa.array([k] * len(u), pa.string()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.int64())], schema=schema) for k, u, v, w in parts])

    return rows.groupBy("g", "b", "s", "b2", "s2").applyInArrow(run, "kind string, u long, v long, w long")


def _tasks(groups: DataFrame, threshold: float, total: int) -> DataFrame:
    """Members of groups (g, tree, cid, home, size) with the tasks that they take part in: k, and b, s, b2, s2, side.

    A group is laid in bands by the logarithm of the set's size, since linked
    sets differ in size by the threshold at most, and a band in blocks by salt.
    A task is a pair of blocks of one band or of neighbouring ones; a small group
    is one task.
    """
    step = float(np.log(1 / threshold))
    placed = groups.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / step + 1e-9))
    bands = placed.groupBy("g", "band").agg(F.count("*").alias("c"), F.sum("size").alias("w")).select("g", "band", "c", "w", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("w") / WEIGHT)).cast("int").alias("salts"))
    all_ = bands.groupBy("g").agg(F.sum("c").alias("all"), F.sum("w").alias("heavy"), F.sort_array(F.collect_list(F.struct("band", "salts"))).alias("plan"))
    # bands of a group are few: the logarithm of the longest text, times a constant
    large = all_.where((F.col("all") > BLOCK) | (F.col("heavy") > WEIGHT)).select("g", "plan")
    rows = lookup(placed, large, ["g"], hot(all_, ["g"], total, "all"), "left")
    n_salts = lambda b: F.coalesce(F.get(F.filter("plan", lambda x: x["band"] == b), 0)["salts"], F.lit(0))
    rows = rows.withColumns({"_own": n_salts(F.col("band")), "_up": n_salts(F.col("band") + 1), "_down": n_salts(F.col("band") - 1)}).withColumn("_salt", F.when(F.col("plan").isNotNull(), F.pmod(F.xxhash64("cid"), F.col("_own"))).otherwise(0).cast("int"))
    key = lambda b, s, b2, s2, side: F.struct(b.cast("long").alias("b"), s.cast("int").alias("s"), b2.cast("long").alias("b2"), s2.cast("int").alias("s2"), side.cast("int").alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    band, s, zero = F.col("band"), F.col("_salt"), F.lit(0)
    tasks = F.when(F.col("plan").isNull(), F.array(key(zero, zero, zero, zero, zero))).otherwise(
        F.concat(
            F.transform(upto(F.col("_own")), lambda t: key(band, F.least(s, t), band, F.greatest(s, t), F.when(s <= t, 0).otherwise(1))),
            F.transform(upto(F.col("_up")), lambda t: key(band, s, band + 1, t, zero)),
            F.transform(upto(F.col("_down")), lambda t: key(band - 1, t, band, s, F.lit(1))),
        )
    )
    return rows.select("g", "tree", "cid", "home", "size", F.explode(tasks).alias("k")).select("g", "tree", "cid", "home", "size", "k.*")


def _homes(trie: DataFrame, total: int) -> DataFrame:
    """(cid, home) for the classes that share a whole label with others: the least class that two steps over such labels lead to."""
    same = trie.groupBy("tree", "label").agg(F.min("cid").alias("m"), F.count("*").alias("n")).where("n > 1")
    deep = cut(lookup(trie, same, ["tree", "label"], hot(same, ["tree", "label"], total)).select("tree", "label", "cid", "m", "n"), "forest-deep")
    one = deep.groupBy("cid").agg(F.min("m").alias("h"))
    low = deep.select("tree", "label", "cid").join(one, "cid").groupBy("tree", "label").agg(F.min("h").alias("h"))
    heavy = hot(deep, ["tree", "label"], total)
    out = cut(lookup(deep.select("tree", "label", "cid"), low, ["tree", "label"], heavy).groupBy("cid").agg(F.min("h").alias("home")), "forest-homes")
    forget(deep)
    return out


def classes(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, trees: int = TREES, most: int = MAX_DEPTH, target: float = TARGET_RECALL, report: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(sigs, final) for `docs` (doc_id, text): sigs has doc_id, _t (md5 of the text), ck; final has, for the classes with a link or a copy, ck, root, class_id, keep_id, keep_t (the row to keep of the class), n_links, n_class, n_docs. Both are written tables.

    `report`, if given, gets the depths visited, the pairs that nodes of the
    least depth propose (with repeats), and the pairs verified, on labels first.
    """
    spark = docs.sparkSession
    least = least_depth(threshold, trees, most, target)
    sigs = cut(signatures(docs, n, trees, most), "forest-sigs")
    # one representative of each class: all that is compared
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t"))
    one = sigs.where("ck is not null").groupBy("ck").agg(first.alias("r"), F.first("size").alias("size"), F.first("label").alias("label"), F.count("*").alias("n_docs"))
    classed = cut(one.select("ck", "r.none", "r.doc_id", "r._t", "size", "label", "n_docs").withColumn("cid", F.monotonically_increasing_id()), "forest-classes")
    total = classed.count()
    # the labels are with the classes now
    labelled, sigs = sigs, cut(sigs.select("doc_id", "_t", "ck"), "forest-ids")
    forget(labelled)
    # the tries: of each tree, the labels that share a node of the least depth with another one, in order
    split = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("label"), t * (2 * most) + 1, F.lit(2 * most)))
    rows = classed.select("cid", F.posexplode(split).alias("tree", "label")).withColumn("node", F.substring("label", 1, 2 * least))
    shared = cut(rows.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1"), "forest-shared")
    trie = lookup(rows, shared, ["tree", "node"], hot(shared, ["tree", "node"], total)).select("tree", "label", "cid")
    trie = cut(trie.repartitionByRange("tree", "label", "cid").sortWithinPartitions("tree", "label", "cid"), "forest-trie")
    tidy(spark)
    # the texts of the classes that met another one are read again, once
    met = cut(classed.join(trie.select("cid").distinct(), "cid").select("cid", "doc_id", "_t", "label", "n_docs"), "forest-met")
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_t"), "text")
    bits, caught = sieve(met, F.xxhash64("doc_id", "_t"), F.xxhash64("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    texts = keyed.join(bits, caught, "left_semi").join(met, keyed["doc_id"].eqNullSafe(met["doc_id"]) & (keyed["_t"] == met["_t"]), "inner").select("cid", "label", "n_docs", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in _slices(batches):
            new = [i for i, c in enumerate(batch.column(0).to_pylist()) if not (c in done or done.add(c))]
            batch = batch.take(pa.array(new, pa.int64()))
            got = [shingles(t.as_py(), n).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, pa.binary())], names=["cid", "label", "n_docs", "set"])

    about = cut(texts.mapInArrow(encode, "cid long, label binary, n_docs long, set binary"), "forest-sets")
    forget(met)
    tidy(spark)
    homes = _homes(trie, total)
    member = cut(trie.join(homes, "cid", "left").join(classed.select("cid", "size"), "cid").select("tree", "label", "cid", F.coalesce("home", "cid").alias("home"), "size"), "forest-members")
    sizes = homes.groupBy("home").agg(F.count("*").alias("n")).where("n > 1")
    at_home = lookup(homes, sizes, ["home"], hot(sizes, ["home"], total)).join(classed.select("cid", "size"), "cid").select(F.col("home").cast("string").cast("binary").alias("g"), F.lit(-1).alias("tree"), "cid", "home", "size")
    tables, histogram, verified, depths = [], np.zeros((most + 1, BINS)), 0, [most]

    def verify(groups: DataFrame, d: int, before: int | None) -> int:
        near = groups is at_home
        groups = cut(groups, "forest-groups")
        tidy(spark)
        tasks, close = _tasks(groups, threshold, total), None
        if not near:
            # most classes that share a short prefix only are far from equal: their sets stay where they are
            close = cut(_screened(tasks.join(about.select("cid", "label"), "cid"), d, before, least, trees, most, threshold), "forest-close")
            tidy(spark)
            compared = close.agg(F.sum("pairs")).first()[0] or 0
            tasks = close.where("cid is not null").drop("pairs")
        else:
            tasks, compared = tasks.drop("size"), None
        tables.append(cut(_verify(tasks.join(about, "cid"), d, before, least, trees, most, threshold), "forest-found"))
        forget(groups, *([close] if close is not None else []))
        count = 0
        for r in tables[-1].where("kind in ('s', 'n')").groupBy("kind", "u").agg(F.sum("w").alias("w")).collect():
            if r["kind"] == "n":
                count += r["w"]
            else:
                histogram[divmod(r["u"], BINS)] += r["w"]
        return count if compared is None else compared

    verified += verify(at_home, most, None)
    before, d = None, most
    while before is None or d < before:
        d = next_depth(histogram[d:].sum(axis=0), d, least, threshold, trees, target)
        if before is not None and d >= before:
            break
        node = F.substring("label", 1, 2 * d)
        mixed = member.groupBy("tree", node.alias("node")).agg(F.count("*").alias("n"), F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo <> hi")
        mixed = cut(mixed.select("tree", "node", "n"), "forest-nodes")
        held = lookup(member.withColumn("node", node), mixed, ["tree", "node"], hot(mixed, ["tree", "node"], total))
        verified += verify(held.select(F.concat(F.col("tree").cast("string").cast("binary"), F.lit(b":"), "node").alias("g"), "tree", "cid", "home", "size"), d, before)
        forget(mixed)
        depths.append(d)
        before = d
        tidy(spark)
    if report is not None:
        proposed = shared.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
        report.update(depths=depths, proposed=int(proposed or 0), verified=verified)
    links = tables[0]
    for t in tables[1:]:
        links = links.union(t)
    roots = components(links.where("kind = 'e'").select("u", "v"))
    linked = links.where("kind = 'l'").groupBy(F.col("u").alias("cid")).agg(F.sum("w").alias("w"))
    members = classed.select("cid", "ck", "none", "doc_id", "_t", "n_docs").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(linked, "cid", "left").withColumn("root", F.coalesce("root", "cid")).where("w > 0 or n_docs > 1")
    members = cut(members, "forest-linked")
    best = F.min(F.struct("none", "doc_id", "_t")).alias("k")
    groups = cut(members.groupBy("root").agg(best, F.sum("n_docs").alias("n_class"), F.count("*").alias("n")), "forest-roots")
    with_group = lookup(members.select("ck", "root", "n_docs", "w"), groups, ["root"], hot(groups, ["root"], total))
    final = cut(with_group.select("ck", "root", F.col("k.doc_id").alias("class_id"), F.col("k.doc_id").alias("keep_id"), F.col("k._t").alias("keep_t"), (F.coalesce("w", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"), "n_class", "n_docs"), "forest-final")
    forget(classed, shared, trie, about, homes, member, roots, members, groups, *tables)
    return sigs, final


def join(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_class.

    Two documents are linked if the Jaccard similarity of their shingle sets is
    at least `threshold`; n_links counts a document's links, copies included.
    class_id is the smallest doc_id that links lead to (a document without a
    link is its own class), n_class the number of documents of the class.
    Null texts and texts without words have no shingle and no link. Repeated
    rows are copies of one another, and each gets its row; rows of one id and
    different texts are documents of their own. A null id is kept and gets a
    class like any other; a class of null ids only has a null class_id. An empty
    table gives none. Other columns are not read. Copies are folded into one
    class before anything is compared, and large groups of near copies are
    compared in blocks of BLOCK classes, by salt and by size.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs, final = classes(base, n, threshold, trees, **params)
    many = hot(final, ["ck"], sigs.count(), "n_docs")
    out = lookup(sigs.select("doc_id", "ck"), final.select("ck", "class_id", "n_links", "n_class"), ["ck"], many, "left")
    return out.select("doc_id", F.when(F.col("n_class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """`docs` with one row of each class of near copies: the one with the smallest id (a null id only if there is no other), of equal ids the text with the smallest md5; of rows equal in id and text one is kept.

    Rows that are in no class with others all stay, those without words too. A
    row is known by its id and its text, so ids that occur with several texts
    lose only the texts that are near copies. Other columns may have any name.
    """
    cols = docs.columns
    safe, at = plain_names(docs)
    ident, text = F.col(at[id_col]), F.col(at[text_col])
    base = safe.select(ident.cast("long").alias("doc_id"), text.alias("text"))
    sigs, final = classes(base, **params)
    many = hot(final, ["ck"], sigs.count(), "n_docs")
    judged = lookup(sigs.select("doc_id", "_t", "ck"), final.where("n_class > 1").select("ck", "keep_id", "keep_t"), ["ck"], many)
    judged = cut(judged.groupBy("doc_id", "_t", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_t") == F.col("keep_t"))).alias("kept")).agg(F.count("*").alias("n")), "forest-judged")
    forget(sigs, final)
    mark = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    same = lambda t: ident.cast("long").eqNullSafe(t["doc_id"]) & (mark == t["_t"])
    gone = judged.where("not kept")
    # only the texts that the sieve holds back are shuffled to be compared
    bits, caught = sieve(gone, F.xxhash64("doc_id", "_t"), F.xxhash64(ident.cast("long"), mark))
    stay = safe.join(bits, caught, "left_anti").union(safe.join(bits, caught, "left_semi").join(gone, same(gone), "left_anti"))
    again = judged.where("kept and n > 1")
    if again.limit(1).count():
        # of equal rows that stand for a class, one
        twice = safe.join(again, same(again), "left_semi").withColumns({"_id": ident, "_t": mark}).dropDuplicates(["_id", "_t"]).drop("_id", "_t")
        stay = stay.join(again, same(again), "left_anti").union(twice)
    return stay.toDF(*cols)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return join(read(spark, sf_dir, "documents"))
