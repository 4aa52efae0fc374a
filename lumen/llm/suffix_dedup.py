"""Removal of repeated byte strings by column-wise suffix ordering.

Every string of WIDTH bytes is owned by its anchor, the K-byte gram of least
hash in it, so equal strings have equal anchors at equal places. Anchors that
occur once are dropped. Around each other one stands a snippet: the bytes of all
strings it owns. Snippets of one anchor are laid out in columns, counted from
the anchor, and ordered from the last column to the first: each round takes one
symbol of every snippet, reorders them stably by it (a collection
Burrows-Wheeler transform, one column a round) and updates the common prefixes
of neighbours. A string is repeated if its suffix shares WIDTH bytes with a
neighbour at that round, or if its snippet occurs again as a whole. Rounds are
bounded by twice WIDTH, not by the longest document.

Copies of a snippet are folded first. An anchor with more than GROUP different
snippets is split by halves of its owned places; the bytes that all strings of
a half have in common join the key, down to a single place, where equal keys
are equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, tidy
from .jaccard_join import _mix, _powers

WIDTH, K = 200, 64
#: Grams of a string; an anchor owns strings that start up to SPAN - 1 bytes before it.
SPAN = WIDTH - K + 1
assert SPAN <= 256
#: Different snippets of one anchor that a task takes, and snippets of several anchors that it takes at once.
GROUP, BATCH = 4096, 8192
_SEGMENT = 1 << 21
_AT = 23  # bits of a place in a segment


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: first and last start owned, place, and hash of each anchor, in order."""
    parts = [_anchors(data[lo : lo + _SEGMENT + WIDTH - 1], lo) for lo in range(0, max(1, len(data) - WIDTH + 1), _SEGMENT)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(data: bytes, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) - WIDTH + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    raw = np.frombuffer(data, np.uint8)
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    grams = _mix((total[K:] - total[:-K]) * down[: len(raw) - K + 1])
    # least hash in each run of SPAN grams, the first of equal ones: hash above, place below
    rank = (grams >> np.uint64(_AT + 1) << np.uint64(_AT)) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(rank) // SPAN)
    padded = np.full(blocks * SPAN, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(rank)] = rank
    grid = padded.reshape(blocks, SPAN)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(after[:n], before[SPAN - 1 : SPAN - 1 + n])
    place = (least & np.uint64((1 << _AT) - 1)).astype(np.int64)
    lo = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    hi = np.r_[lo[1:] - 1, n - 1]
    at = place[lo]
    return lo + base, hi + base, at + base, grams[at].view(np.int64)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi] for each pair, by tables of doubling width."""
    length = hi - lo + 1
    out = np.empty(len(lo), values.dtype)
    level, table = 0, values
    power = np.frexp(length.astype(np.float64))[1] - 1
    for p in range(int(power.max(initial=0)) + 1):
        if p:
            half = 1 << level
            table = np.minimum(table[:-half], table[half:])
            level = p
        here = power == p
        if here.any():
            out[here] = np.minimum(table[lo[here]], table[hi[here] - (1 << p) + 1])
    return out


def repeated(snippets: list[bytes], first: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """Of each snippet, which of its strings occur in another one of its group.

    first: column of its first byte, relative to its anchor; group: sorted. The
    result holds a boolean for each of its starts.
    """
    n = len(snippets)
    lengths = np.array([len(s) for s in snippets])
    left, right = int(first.min()), int((first + lengths).max())
    grid = np.full((right - left, n), -1, np.int16)
    flat = np.frombuffer(b"".join(snippets), np.uint8)
    own = np.repeat(np.arange(n), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first - left, lengths)
    grid[column, own] = flat
    _, rank = np.unique(group, return_inverse=True)
    rank = rank.astype(np.int64) << 9
    order = np.arange(n)
    common = np.zeros(n, np.int32)  # with the snippet before, in this order
    out = np.zeros((right - left, n), bool)
    for c in range(right - left - 1, -1, -1):
        symbol = grid[c, order].astype(np.int64)
        key = rank[order] + symbol + 1
        step = np.argsort(key, kind="stable")
        new, sorted_key = order[step], key[step]
        same = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (symbol[step][1:] >= 0)) + 1
        fresh = np.zeros(n, np.int32)
        if len(same):
            fresh[same] = 1 + _range_min(common, step[same - 1] + 1, step[same])
        order, common = new, fresh
        hit = common >= WIDTH
        if hit.any():
            hit[:-1] |= hit[1:]
            out[c, order[hit]] = True
    return [out[f - left : f - left + m - WIDTH + 1, i] for i, (f, m) in enumerate(zip(first.tolist(), lengths.tolist(), strict=True))]


def _ranges(starts: np.ndarray) -> list[int]:
    """Sorted starts as flat pairs of first and last."""
    if not len(starts):
        return []
    cut_ = np.flatnonzero(np.diff(starts) > 1)
    return np.column_stack([np.r_[starts[0], starts[cut_ + 1]], np.r_[starts[cut_], starts[-1]]]).reshape(-1).tolist()


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by column `key`, in tables of whole keys."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            table = pa.Table.from_batches(held)
            last = table["key"][rows - 1].as_py()
            keys = table["key"].combine_chunks().to_pylist()
            end = rows
            while end and keys[end - 1] == last:
                end -= 1
            if end:
                yield table.slice(0, end)
                held, rows = table.slice(end).to_batches(), rows - end
    if held:
        yield pa.Table.from_batches(held)


def _order(rows: DataFrame) -> DataFrame:
    """(sid, pairs): the repeated strings of each snippet (key, sid, first, bytes), as first and last place from its anchor. Keys have two different snippets at least, and GROUP at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_groups(batches):
            group = np.array(table["key"].to_pylist(), dtype=object)
            _, code = np.unique(group, return_inverse=True)
            first = table["first"].to_numpy().astype(np.int64)
            found = repeated(table["bytes"].to_pylist(), first, code)
            pairs = [_ranges(np.flatnonzero(f) + a) for f, a in zip(found, first.tolist(), strict=True)]
            used = np.flatnonzero([len(p) > 0 for p in pairs])
            if len(used):
                yield pa.RecordBatch.from_arrays([table["sid"].combine_chunks().take(pa.array(used)), pa.array([pairs[i] for i in used], pa.list_(pa.int32()))], names=["sid", "pairs"])

    dealt = rows.select("key", "sid", "first", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "sid binary, pairs array<int>")


def _md5(c: Column) -> Column:
    return F.unhex(F.md5(c))


def _resolve(rows: DataFrame, lo: int, hi: int, level: int) -> list[DataFrame]:
    """Tables (sid, pairs) for snippets (key, sid, first, bytes, n) whose owned places lie from `lo` to `hi`; n: how often the snippet occurs."""
    # a part equals another one: all its strings are repeated, and one of the copies stands for all
    if level:
        mark = cut(rows.withColumn("part", _md5(F.concat("key", F.col("first").cast("string").cast("binary"), "bytes"))), "suffix-parts")
        whole = mark.groupBy("part").agg(F.sum("n").alias("total"), F.min("sid").alias("one"))
        mark = mark.join(whole, "part")
        done = [mark.where("total > 1").select("sid", F.array("first", F.col("first") + F.length("bytes") - WIDTH).alias("pairs"))]
        rows = mark.where("sid = one").withColumn("alone", F.col("total") == 1)
    else:
        done = [rows.where("n > 1").select("sid", F.array("first", F.col("first") + F.length("bytes") - WIDTH).alias("pairs"))]
        rows = rows.withColumn("alone", F.col("n") == 1)
    sizes = rows.groupBy("key").agg(F.count("*").alias("c"), F.count_if("alone").alias("open")).where("c > 1 and open > 0")
    rows = cut(rows.join(sizes, "key").select("key", "sid", "first", "bytes", "n", "c"), "suffix-groups")
    done.append(_order(rows.where(F.col("c") <= GROUP)))
    hot = rows.where(F.col("c") > GROUP)
    if lo == hi or not hot.limit(1).count():
        return done
    mid = (lo + hi) // 2
    for a, b in ((lo, mid), (mid + 1, hi)):
        # places of the snippet inside the half, and the bytes common to all strings of the half
        begin, end = F.greatest("first", F.lit(a)), F.least(F.col("first") + F.length("bytes") - WIDTH, F.lit(b))
        part = hot.where(begin <= end).select("key", "sid", "n", begin.cast("int").alias("first"), F.col("bytes").substr(begin - F.col("first") + 1, end - begin + WIDTH).alias("bytes"))
        core = F.col("bytes").substr(F.lit(b) - F.col("first") + 1, F.lit(a - b + WIDTH))
        done += _resolve(part.withColumn("key", _md5(F.concat(F.col("key"), core))), a, b, level + 1)
    return done


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(base, found): base has a row a document, doc_id, dk (its key), n_bytes, sha (of the whole text); found has dk and `p`, the first byte of each string run to remove and the one after its last, for documents with any. Both are written to the shared folder."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = _md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(data)).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("dk"), data.alias("data"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "dk", "n_bytes", "sha", "w", "h"]
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts = [x.as_py() for x in part.column(2)]
                got = [anchors(t) for t in texts]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32))
                lo, hi, at, h = (np.concatenate([g[j] for g in got]) for j in range(4))
                # place, bytes from the first start to it, and number of starts but one, in one number
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at << 16 | (at - lo) << 8 | (hi - lo), h)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), *lists], names=names)

    scanned = rows.mapInArrow(scan, f"doc_id {kind}, dk binary, n_bytes long, sha string, w array<long>, h array<long>")
    all_ = cut(scanned.withColumn("rid", F.monotonically_increasing_id()), "suffix-anchors")
    often = all_.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    each = all_.select("rid", F.explode(F.arrays_zip("w", "h")).alias("x")).select("rid", "x.*")
    wanted = cut(each.join(often, "h").groupBy("rid").agg(F.collect_list("w").alias("want")), "suffix-wanted")
    base = cut(all_.select("doc_id", "dk", "rid", "n_bytes", "sha"), "suffix-base")
    forget(all_)
    tidy(spark)
    # repeated rows have one key; their places are the same
    keyed = wanted.join(base.select("rid", "dk"), "rid").groupBy("dk").agg(F.first("want").alias("want"))
    texts = rows.select("dk", "data").join(keyed, "dk")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dk", "at", "key", "sid", "first", "bytes"]
        seen: set[bytes] = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                out: list[list] = [[] for _ in names]
                for dk, data_, want in zip(*(part.column(j).to_pylist() for j in (0, 1, 2)), strict=True):
                    for w in sorted(set(want)):
                        at = w >> 16
                        lo = at - (w >> 8 & 255)
                        raw = data_[lo : lo + (w & 255) + WIDTH]
                        h = hashlib.md5(data_[at : at + K]).digest()[:8]
                        sid = hashlib.md5(h + (at - lo).to_bytes(4, "little") + raw).digest()
                        # a snippet's bytes are sent once a task at most
                        row = (dk, at, h, sid, lo - at, None if sid in seen else raw)
                        seen.add(sid)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    taken = cut(texts.select("dk", "data", "want").mapInArrow(cut_out, "dk binary, at int, key binary, sid binary, first int, bytes binary"), "suffix-snippets")
    tidy(spark)
    snippets = cut(taken.groupBy("sid").agg(F.first("key").alias("key"), F.first("first").alias("first"), F.first("bytes", ignorenulls=True).alias("bytes"), F.count("*").alias("n")), "suffix-distinct")
    tidy(spark)
    parts = _resolve(snippets, 1 - SPAN, 0, 0)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    pairs = F.transform(F.sequence(F.lit(0), F.size("pairs") - 2, F.lit(2)), lambda i: F.struct((F.col("at") + F.get("pairs", i)).alias("s"), (F.col("at") + F.get("pairs", i + 1) + WIDTH).alias("e")))
    placed = taken.select("dk", "at", "sid").join(hits, "sid").select("dk", pairs.alias("p"))
    found = cut(placed.groupBy("dk").agg(F.flatten(F.collect_list("p")).alias("p")), "suffix-found")
    for table in (wanted, taken, snippets):
        forget(table)
    tidy(spark)
    return base.select("doc_id", "dk", "n_bytes", "sha"), found


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes that remain; null where all do).

    A byte goes if a string of WIDTH bytes that covers it starts anywhere else,
    in the same document too; judged on the input. Null is the empty text;
    texts under WIDTH bytes keep all. Repeated rows are occurrences like any
    other. Null ids are kept. An empty table gives none. Only the two named
    columns are read, so others may have any name.
    """
    base, found = spans(docs, id_col, text_col)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = _md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(data)).cast("binary"))
    texts = docs.select(key.alias("dk"), data.alias("data")).join(found, "dk")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for dk, raw, p in zip(*(batch.column(j).to_pylist() for j in (0, 1, 2)), strict=True):
                kept, at, runs, end = [], 0, 0, -1
                for x in sorted(p, key=lambda x: (x["s"], x["e"])):
                    if x["s"] > end:
                        runs += 1
                        kept.append(raw[at : x["s"]])
                    end = max(end, x["e"])
                    at = end
                kept = b"".join([*kept, raw[at:]])
                rows.append((dk, len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)] if rows else [pa.array([], k) for k in (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())], names=["dk", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = texts.mapInArrow(keep, "dk binary, n_removed long, n_spans long, kept_sha256 string, kept binary").dropDuplicates(["dk"])
    out = base.join(done, "dk", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return remove(read(spark, sf_dir, "documents")).drop("kept")
