"""Prefix trie of conversations, as the Cartesian tree of the sorted conversations' common prefixes.

Equal conversations are put together first, and the distinct ones sorted, turn
by turn, over range partitions. lcp[i] is the number of turns that i shares with
i - 1. A node with several children is a run [p, q) of sorted conversations: p
and q are the nearest places left and right of some i whose lcp is smaller than
lcp[i], and lcp[i] is its depth; equal values with no smaller one between them
are one node. Each partition finds its own nearest smaller values with a stack.
Those beyond its border are found by the partitions' least values, a table of
one row a partition: they name the partition that holds the place, and its
records (the values that are smaller than all before, or all behind, them) the
place itself. Sums and least ids over [p, q) are differences of running sums
and the least of three. Depths between a node and its parent have the node's
conversations, and are written out last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: Turns of a partition, the most partitions, and ids hashed as one text.
PART_TURNS, MOST_PARTS, CHUNK = 100_000, 20_000, 256
NOTHING = hashlib.sha256(b"").hexdigest()
SUMS = ("convs", "bytes", "fresh", "leaves")


def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: the turns of a conversation in order, each as (key, bytes), the digest of role and text and the byte count of the text.

    Turns are ordered by `turn`, null first, and equal ones by key; a null role or
    text is empty, a repeated row is a turn of its own, and rows without
    conversation take no part. A conversation is one row: 16 bytes and a count a turn.
    """
    at = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(at(role)).cast("string"), F.lit(":"), at(role), at(text)).cast("binary")))
    rows = df.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), key.alias("key"), F.octet_length(at(text)).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes"))).alias("turns"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sid, conv_id): up to CHUNK ids of a sid at a time, as text."""
    names = ["sid", "first", "m", "ids"]
    for batch in batches:
        sids, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows, begin = [], 0
        for i in range(1, len(sids) + 1):
            if i == len(sids) or sids[i] != sids[begin] or i - begin == CHUNK:
                rows.append((sids[begin], ids[begin], i - begin, ",".join(map(str, ids[begin:i]))))
                begin = i
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (sid, first): number, least id and digest of all ids of a sid, read as a stream."""
    out, now = [], None

    def made():
        rows = [(s, n, low, h.hexdigest()) for s, n, low, h in out]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["sid", "copies", "least", "ends"])

    for batch in batches:
        for sid, first, m, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and now[0] == sid:
                now[1] += m
                now[3].update(b"," + ids.encode())
                continue
            if now is not None:
                out.append(now)
            now = [sid, m, first, hashlib.sha256(ids.encode())]
        if out:
            yield made()
    if now is not None:
        out.append(now)
        yield made()


class Part:
    """The sorted conversations of a partition, their common prefixes and the groups of equal ones.

    `lcp` has the first conversation's too (with the partition before, -1 at the
    start of all) and, where the next partition's first is known, that one at the
    end. `before` is the first one's value, or the conversation before it.
    """

    def __init__(self, rows: pa.Table, before: int | list, after: int | None = None):
        rows = rows.take(pa.array(np.argsort(rows["row"].to_numpy()))).combine_chunks()
        self.turns = [[(t["key"], t["bytes"]) for t in ts] for ts in rows["turns"].to_pylist()]
        first = before if isinstance(before, int) else common(before, self.turns[0])
        self.copies, self.least = (rows[c].to_numpy().astype(np.int64) for c in ("copies", "least"))
        self.ends = rows["ends"].to_pylist()
        n = self.n = len(self.turns)
        self.length = np.array([len(t) for t in self.turns], np.int64)
        self.upto = [np.concatenate([[0], np.cumsum([b for _, b in t], dtype=np.int64)]) for t in self.turns]
        self.total = np.array([u[-1] for u in self.upto], np.int64)
        self.lcp = [first, *(common(a, b) for a, b in zip(self.turns, self.turns[1:], strict=False))] + ([] if after is None else [after])
        self.fresh = np.array([self.total[i] - self.upto[i][max(0, self.lcp[i])] for i in range(n)], np.int64)
        leaf = np.array([self.lcp[i + 1] < self.length[i] if i + 1 < len(self.lcp) else False for i in range(n)], np.int64)
        self.sums = np.stack([np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (self.copies, self.copies * self.total, self.fresh, leaf)])
        self._groups()

    def _groups(self) -> None:
        """value, first and last place, size, and nearest smaller places (None: beyond the border) of each group; left-to-right and right-to-left records."""
        self.groups: list[list] = []
        self.of, stack, self.heads = [], [], []
        for i in range(self.n):
            x = self.lcp[i]
            while stack and self.groups[stack[-1]][0] > x:
                self.groups[stack.pop()][5] = i
            if stack and self.groups[stack[-1]][0] == x:
                g = stack[-1]
                self.groups[g][2] = i
                self.groups[g][3] += 1
            else:
                g = len(self.groups)
                if not stack:
                    self.heads.append(g)
                self.groups.append([x, i, i, 1, self.groups[stack[-1]][2] if stack else None, None])
                stack.append(g)
            self.of.append(g)
        self.tails = stack

    def lows(self) -> list[np.ndarray]:
        """Least ids over runs of 1, 2, 4, ... conversations."""
        return halving(self.least)


def halving(x: np.ndarray) -> list[np.ndarray]:
    out, w = [x], 1
    while 2 * w <= len(x):
        out.append(np.minimum(out[-1][: len(x) - 2 * w + 1], out[-1][w : len(x) - w + 1]))
        w *= 2
    return out


def least(table: list[np.ndarray], a: int, b: int) -> int:
    """The least of [a, b)."""
    k = (b - a).bit_length() - 1
    return int(min(table[k][a], table[k][b - (1 << k)]))


def common(a: list, b: list) -> int:
    """Turns that two conversations share at their start."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i][0] != b[i][0]:
            return i
    return n


FOUND = "kind string, part int, gid long, value long, size long, known_left boolean, known_right boolean, place long, convs long, bytes long, fresh long, leaves long, own long, least long, length long, total long"


def _table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split(" ") for f in ddl.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


def _find(left: pa.Table, right: pa.Table) -> pa.Table:
    """First pass over a partition: its summary, its records, and the groups that reach beyond it."""
    if not left.num_rows:
        return _table([], FOUND)
    part = left["part"][0].as_py()
    p = Part(left, [(t["key"], t["bytes"]) for t in right["_last"][0].as_py()] if right.num_rows else -1)
    rows = [{"kind": "part", "part": part, "size": p.n, "value": min(p.lcp), "place": p.lcp[0], "least": int(p.least.min()), "length": int(p.length[-1])} | dict(zip(SUMS, map(int, p.sums[:, -1]), strict=True))]
    forward, backward = np.minimum.accumulate(p.least), np.minimum.accumulate(p.least[::-1])[::-1]
    for kind, gs, at in (("left", p.tails, 2), ("right", p.heads, 1)):
        for g in gs:
            i = p.groups[g][at]
            low = backward[i] if kind == "left" else forward[i - 1] if i else np.iinfo(np.int64).max
            rows.append({"kind": kind, "part": part, "gid": g, "value": p.groups[g][0], "place": i, "own": int(p.fresh[i]), "least": int(low), "length": int(p.length[i]), "total": int(p.total[i])} | dict(zip(SUMS, map(int, p.sums[:, i]), strict=True)))
    for g, (v, _, _, size, a, b) in enumerate(p.groups):
        if v >= 0 and (a is None or b is None):
            rows.append({"kind": "open", "part": part, "gid": g, "value": v, "size": size, "known_left": a is not None, "known_right": b is not None})
    return _table(rows, FOUND)


class Parts:
    """The partitions' summaries: a row each, and so bounded by MOST_PARTS."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["part"])
        self.ids = [r["part"] for r in rows]
        self.at = {p: i for i, p in enumerate(self.ids)}
        self.low, self.first = [r["value"] for r in rows], [*(r["place"] for r in rows[1:]), -1]
        self.opening = [r["place"] for r in rows]
        ends = np.array([f < r["length"] for f, r in zip(self.first, rows, strict=True)], np.int64)
        each = np.array([[r[s] for r in rows] for s in SUMS], np.int64).reshape(len(SUMS), len(rows))
        each[3] += ends
        self.before = np.concatenate([np.zeros((len(SUMS), 1), np.int64), np.cumsum(each, axis=1)], axis=1)
        self.lows = halving(np.array([r["least"] for r in rows], np.int64))
        self.left = self._smaller(range(len(rows)))
        self.right = self._smaller(range(len(rows) - 1, -1, -1))

    def _smaller(self, order) -> list:
        out, stack = [None] * len(self.low), []
        for i in order:
            while stack and self.low[stack[-1]] >= self.low[i]:
                stack.pop()
            out[i] = stack[-1] if stack else None
            stack.append(i)
        return out

    def nearest(self, part: int, value: int, side: str) -> int | None:
        """The nearest partition on a side whose least value is smaller: along the chain of ever smaller ones."""
        i, chain = self.at[part], self.left if side == "left" else self.right
        i = i - 1 if side == "left" else i + 1
        while i is not None and 0 <= i < len(self.low) and self.low[i] >= value:
            i = chain[i]
        return self.ids[i] if i is not None and 0 <= i < len(self.low) else None


ASKED = "part int, gid long, value long, size long, side string, target int"
ANSWER = "part int, gid long, value long, size long, at_part int, at_gid long, at_value long, place long, convs long, bytes long, fresh long, leaves long, own long, least long, length long, total long"
_RECORD = ("place", *SUMS, "own", "least", "length", "total")


def _ask(parts: Parts):
    """Which partition holds the nearest smaller value on either side of each open group (null: none does)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for side in ("left", "right"):
                    target = r["part"] if r[f"known_{side}"] else parts.nearest(r["part"], r["value"], side)
                    rows.append({k: r[k] for k in ("part", "gid", "value", "size")} | {"side": side, "target": target})
            yield from _table(rows, ASKED).to_batches()

    return run


def _answer(asked: pa.Table, records: pa.Table) -> pa.Table:
    """The record with the greatest value below the one asked for: the nearest place with a smaller value."""
    have = sorted(records.to_pylist(), key=lambda r: r["_value"])
    values, rows = np.array([r["_value"] for r in have]), []
    for a in asked.to_pylist():
        k = int(np.searchsorted(values, a["value"])) - 1
        r = have[k] if k >= 0 else None
        rows.append({k: a[k] for k in ("part", "gid", "value", "size")} | ({} if r is None else {"at_part": r["_part"], "at_gid": r["_gid"], "at_value": r["_value"]} | {c: r[f"_{c}"] for c in _RECORD}))
    return _table(rows, ANSWER)


NODE = "part int, gid long, value long, size long, place_part int, place long, above long, above_part int, above_gid long, convs long, bytes long, fresh long, leaves long, least long"


def _measure(parts: Parts):
    """Sums and least id of each open group's run, from its two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                i, j = parts.at[r["l_at_part"]], parts.at[r["r_at_part"]] if r["r_at_part"] is not None else len(parts.ids)
                start = [int(parts.before[k][i]) + r[f"l_{s}"] for k, s in enumerate(SUMS)]
                end = [int(parts.before[k][j]) + (r[f"r_{s}"] or 0) for k, s in enumerate(SUMS)]
                lows = [r["l_least"]] + ([r["r_least"]] if r["r_at_part"] is not None else []) + ([least(parts.lows, i + 1, j)] if j > i + 1 else [])
                a, b = r["l_at_value"], -1 if r["r_at_part"] is None else r["r_at_value"]
                above = max(a, b)
                up = (None, None) if above < 0 else (r["l_at_part"], r["l_at_gid"]) if a >= b else (r["r_at_part"], r["r_at_gid"])
                made = dict(zip(SUMS, (e - s for s, e in zip(start, end, strict=True)), strict=True))
                made["fresh"] -= r["l_own"]
                rows.append({k: r[k] for k in ("part", "gid", "value", "size")} | made | {"place_part": r["l_at_part"], "place": r["l_place"], "above": above, "above_part": up[0], "above_gid": up[1], "least": min(lows)})
            yield from _table(rows, NODE).to_batches()

    return run


OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_key binary"


def _write_out(parts: Parts):
    """Second pass over a partition: all nodes whose run starts in it, with the depths between them and their parents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], OUT)
        at = parts.at[left["part"][0].as_py()]
        p = Part(left, parts.opening[at], parts.first[at])
        rows: list[dict] = []

        def chain(i: int, above: int, depth: int, parent: int | None, low: int, children: int, convs: int, total: int, fresh: int, leaves: int) -> None:
            """The node of a run that starts at i, and the depths above it down from its parent's."""
            ends = p.ends[i] if p.length[i] == depth else NOTHING
            for d in range(above + 1, depth + 1):
                passed = int(p.upto[i][max(0, d - 1)])
                saved = total - convs * passed - fresh - int(p.total[i]) + passed
                rows.append({"conv_id": low, "depth": d, "parent_conv_id": parent if d == above + 1 else low, "n_convs": convs, "n_children": 1 if d < depth else children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends if d == depth else NOTHING, "turn_key": p.turns[i][d - 1][0] if d else None})

        outer, after = {}, None
        for r in right.to_pylist():
            if r["kind"] == "id":
                outer[r["gid"]] = r["least"]
            elif r["kind"] == "after":
                after = r["least"]
        lows = p.lows()
        inner = {g: least(lows, a, b) for g, (v, _, _, _, a, b) in enumerate(p.groups) if a is not None and b is not None}
        known = lambda g: inner[g] if g in inner else outer[g]
        for g, low in inner.items():
            v, _, _, size, a, b = p.groups[g]
            side = a if p.lcp[a] >= p.lcp[b] else b
            convs, total, fresh, leaves = (int(x) for x in p.sums[:, b] - p.sums[:, a])
            chain(a, p.lcp[side], v, known(p.of[side]), low, size + int(p.length[a] != v), convs, total, fresh - int(p.fresh[a]), leaves)
        for i in range(p.n):
            above = max(p.lcp[i], p.lcp[i + 1])
            if p.length[i] > above:
                parent = None if above < 0 else known(p.of[i]) if p.lcp[i] >= p.lcp[i + 1] else known(p.of[i + 1]) if i + 1 < p.n else after
                chain(i, above, int(p.length[i]), parent, int(p.least[i]), 0, int(p.copies[i]), int(p.copies[i] * p.total[i]), 0, 1)
        for r in right.to_pylist():
            if r["kind"] == "node":
                i = r["place"]
                chain(i, r["above"], r["value"], r["parent"], r["least"], r["size"] + int(p.length[i] != r["value"]), r["convs"], r["bytes"], r["fresh"], r["leaves"])
        return _table(rows, OUT)

    return run


def trie(convs: DataFrame) -> DataFrame:
    """A row a node of the trie of `convs` (conv_id, turns; see `sequences`): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_key.

    A node is a distinct sequence of first `depth` turns, from the root, which has
    none; conv_id is the least of the conversations that start with it, n_convs
    their number. saved_tokens is, over the node and all below, the bytes of the
    last turn's text times the conversations beyond the first; ends_sha256 digests
    the ids of those that end there; turn_key is the last turn's key (null at the
    root). A conversation without turns ends at the root; without any conversation
    there is no node. Ids must be distinct, and not null. Equal conversations, of
    which one may have most of the rows, are hashed as a sorted stream of ids.
    """
    spark = convs.sparkSession
    convs = cut(convs.withColumn("sid", F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "").cast("binary"), 256))), "trie-convs")
    members = convs.select("sid", "conv_id").repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    chunks = members.mapInArrow(_chunks, "sid binary, first long, m long, ids string")
    same = chunks.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(_digests, "sid binary, copies long, least long, ends string")
    lone = convs.select("conv_id", "turns").join(same.drop("sid").withColumnRenamed("least", "conv_id"), "conv_id").withColumnRenamed("conv_id", "least")
    lone = cut(lone.withColumn("keys", F.transform("turns", lambda t: t["key"])), "trie-distinct")
    forget(convs)
    count, size = lone.agg(F.count("*"), F.sum(F.size("turns"))).first()
    if not count:
        return spark.createDataFrame([], OUT)
    parts = max(1, min(MOST_PARTS, count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PART_TURNS)))
    dealt = lone.repartitionByRange(parts, "keys").sortWithinPartitions("keys").drop("keys")
    rows = cut(dealt.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "trie-sorted")
    forget(lone)
    there = sorted(r[0] for r in rows.select("part").distinct().collect())
    follow = spark.createDataFrame(list(zip(there, there[1:], strict=False)), "before int, part int")
    last = rows.groupBy(F.col("part").alias("before")).agg(F.max_by("turns", "row").alias("_last")).join(follow, "before").select(F.col("part").alias("_part"), "_last")
    found = cut(rows.groupBy("part").cogroup(last.groupBy("_part")).applyInArrow(_find, FOUND), "trie-found")
    about = Parts(found.where("kind = 'part'").collect())
    asked = found.where("kind = 'open'").select("part", "gid", "value", "size", "known_left", "known_right").mapInArrow(_ask(about), ASKED)
    records = found.where("kind in ('left', 'right')").select(*[F.col(c).alias(f"_{c}") for c in ("kind", "part", "gid", "value", *_RECORD)])
    answers = cut(asked.groupBy("target", "side").cogroup(records.groupBy("_part", "_kind")).applyInArrow(_sided(_answer), f"side string, {ANSWER}").where("part is not null"), "trie-answers")
    ends = {s: answers.where(F.col("side") == s).select("part", "gid", "value", "size", *[F.col(c).alias(f"{s[0]}_{c}") for c in ("at_part", "at_gid", "at_value", *_RECORD)]) for s in ("left", "right")}
    open_ = cut(ends["left"].join(ends["right"].drop("value", "size"), ["part", "gid"]).mapInArrow(_measure(about), NODE), "trie-open")
    forget(found, answers)
    ids = open_.select(F.col("part").alias("above_part"), F.col("gid").alias("above_gid"), F.col("least").alias("parent"))
    # the groups of one run, which agree in all but their size
    nodes = open_.groupBy("place_part", "place", "value").agg(F.sum("size").alias("size"), *[F.first(c).alias(c) for c in ("above", "above_part", "above_gid", *SUMS, "least")]).join(ids, ["above_part", "above_gid"], "left")
    empty = lambda c, t: F.lit(None).cast(t).alias(c)
    columns = ["place", "value", "size", "above", *SUMS, "least", "parent"]
    side = nodes.select(F.col("place_part").alias("_part"), F.lit("node").alias("kind"), empty("gid", "long"), *columns)
    blank = lambda kind, df: df.select("_part", F.lit(kind).alias("kind"), "gid", *[F.col("least") if c == "least" else empty(c, "long") for c in columns])
    side = side.unionByName(blank("id", open_.select(F.col("part").alias("_part"), "gid", "least")))
    side = side.unionByName(blank("after", open_.where("gid = 0").join(follow, "part").select(F.col("before").alias("_part"), "gid", "least")))
    return rows.groupBy("part").cogroup(side.groupBy("_part")).applyInArrow(_write_out(about), OUT)


def _sided(f):
    """`f` with the side of what was asked; records that nobody asked for give no rows."""

    def run(asked: pa.Table, records: pa.Table) -> pa.Table:
        out = f(asked, records)
        return out.add_column(0, "side", asked["side"] if asked.num_rows else pa.array([], pa.string()))

    return run


def query(spark, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: the first h turns of conversation c - c % 5, then c's own turns after its first h; h = crc32(c) % 9."""
    from .common import read

    own = cut(sequences(read(spark, sf_dir, "conversations")), "trie-turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    heads = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("head"), F.slice("turns", 1, 8).alias("start"))
    each = own.withColumns({"h": h, "head": F.expr("conv_id - conv_id % 5")}).join(heads, "head", "left")
    start = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    out = trie(each.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns")))
    forget(own)
    return out.drop("turn_key")


def oracle() -> str:
    """The same in SQL, each node by the digest of its turns."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda y: y::BIGINT)), lambda k, u: CASE WHEN k % 2 = 1 THEN xor(k // 2, 3988292384::BIGINT) ELSE k // 2 END)))"
    return f"""
WITH t AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'k': k, 'b': b}} ORDER BY turn NULLS FIRST, k) AS ts FROM t GROUP BY conv_id),
w AS (SELECT conv_id, ts, conv_id - conv_id % 5 AS head, {crc} % 9 AS h FROM o),
r AS (SELECT w.conv_id, list_concat(coalesce(p.ts[1:w.h], []), w.ts[w.h + 1:]) AS ts FROM w LEFT JOIN o p ON p.conv_id = w.head),
x AS (SELECT conv_id, d, len(ts) AS n, sha256(array_to_string(list_transform(ts[1:d], lambda z: z.k), '')) AS id, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(ts[1:d - 1], lambda z: z.k), '')) END AS up, CASE WHEN d > 0 THEN ts[d].b ELSE 0 END AS b
      FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM r)),
g AS (SELECT id, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM x GROUP BY id, d),
c AS (SELECT up AS id, count(*) AS c FROM g WHERE d > 0 GROUP BY up),
e AS (SELECT g.*, coalesce(c.c, 0) AS c FROM g LEFT JOIN c USING (id)),
s AS (SELECT x.id, sum((e.n - 1) * e.b) AS saved, count(*) FILTER (WHERE e.c = 0) AS leaves FROM e JOIN x ON x.conv_id = e.conv_id AND x.d <= e.d GROUP BY x.id)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, e.n AS n_convs, CAST(e.c AS BIGINT) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, e.ends AS ends_sha256
FROM e JOIN s USING (id) LEFT JOIN g p ON p.id = e.up
"""
