"""Merkle manifest of a table: leaf digests, a tree for each group of rows, one root over all, and a proof for every row.

A fragment is a sparse forest: the nodes whose parent is not known yet, keyed by
level and index. Fragments form a commutative monoid: `merge` unites them and
folds every run of siblings that is complete, which the number of leaves of the
tree decides, into its parent. Rows are dealt by range, so a task's fragment
leaves at most ARITY - 1 nodes open on either side of a level and tree; fragments
are then merged FAN at a time, round by round, until the roots are left. The
rounds are written tables and not an RDD's treeReduce, because the nodes that
proofs need come out of them, and neither they nor the roots pass the driver.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget

#: Children of a node.
ARITY = 8
#: Proofs are put together for the ARITY ** UNIT leaves below a node of this level at once.
UNIT = 4
#: Fragments merged at a time, rows of a part, and the most parts.
FAN, PART_ROWS, MOST_PARTS = 32, 100_000, 20_000
STEP = "struct<before:string,after:string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sizes(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves, up to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def merge(*fragments: dict[tuple[int, int], str], n: int) -> tuple[dict[tuple[int, int], str], dict[tuple[int, int], str]]:
    """The union of fragments of a tree of n leaves, with complete runs folded, and the nodes that were folded. Associative and commutative; {} is neutral."""
    levels: list[dict[int, str]] = [{} for _ in sizes(n)]
    for f in fragments:
        for (level, i), h in f.items():
            levels[level][i] = h
    done = {}
    for level, width in enumerate(sizes(n)[:-1]):
        have = levels[level]
        for parent, found in Counter(i // ARITY for i in have).items():
            first = parent * ARITY
            if found == min(ARITY, width - first):
                run = [have.pop(i) for i in range(first, first + found)]
                done.update({(level, first + k): h for k, h in enumerate(run)})
                levels[level + 1][parent] = digest("".join(run))
    return {(level, i): h for level, have in enumerate(levels) for i, h in have.items()}, done


def hashed(fields: dict[str, Column] | list[str]) -> Column:
    """Digest of a row's fields: `-` for a null, else the byte count, `:` and the value."""
    named = fields if isinstance(fields, dict) else {c: F.col(f"`{c}`") for c in fields}
    texts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in named.values()]
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level and left to right, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def _nodes(rows: list[tuple], kind: str, part: int, schema: pa.Schema) -> pa.Table:
    """Rows (tree, n, level, idx, digest) as a table; the columns of leaves are null."""
    cols = dict(zip(("tree", "n", "level", "idx", "digest"), zip(*rows, strict=True) if rows else [()] * 5, strict=True))
    made = {"kind": [kind] * len(rows), "part": [part] * len(rows)} | {k: list(v) for k, v in cols.items()}
    return pa.table([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(len(rows), f.type) for f in schema], schema=schema)


def _sort_out(tree: str, n: int, now: dict, done: dict, rows: dict[str, list]) -> None:
    """Deal the outcome of a merge to the kinds of rows; nodes folded below UNIT are not needed again."""
    rows["done"] += [(tree, n, level, i, h) for (level, i), h in done.items() if level >= UNIT]
    top = (len(sizes(n)) - 1, 0)
    if top in now:
        rows["root"].append((tree, n, *top, now[top]))
    else:
        rows["open"] += [(tree, n, level, i, h) for (level, i), h in now.items()]


def _lift(key: str, carry: list[str]):
    """For the rows of a part and its segments (tree, start, n): each leaf with its place, and the part's fragment."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, [("tree", "ascending"), (key, "ascending"), ("digest", "ascending")], null_placement="at_start"))
        part = left["part"][0].as_py()
        places = {t: (a, n) for t, a, n in zip(*(right[c].to_pylist() for c in ("_tree", "_start", "_n")), strict=True)}
        trees, hashes = left["tree"].to_pylist(), left["digest"].to_pylist()
        ends = [i for i in range(1, len(trees)) if trees[i] != trees[i - 1]] + [len(trees)]
        idx, total, rows, begin = np.empty(len(trees), np.int64), np.empty(len(trees), np.int64), {"open": [], "done": [], "root": []}, 0
        for end in ends:
            start, n = places[trees[begin]]
            idx[begin:end], total[begin:end] = np.arange(start, start + end - begin), n
            _sort_out(trees[begin], n, *merge({(0, start + k): h for k, h in enumerate(hashes[begin:end])}, n=n), rows)
            begin = end
        made = {"kind": pa.array(["leaf"] * len(trees)), "idx": pa.array(idx), "n": pa.array(total), "level": pa.array(np.zeros(len(trees), np.int32))}
        names = ["kind", "part", "tree", "n", "level", "idx", "digest", key, *carry]
        leaves = pa.table([made[c] if c in made else left[c] for c in names], names=names)
        return pa.concat_tables([leaves, *(_nodes(r, k, part, leaves.schema) for k, r in rows.items())]).combine_chunks()

    return run


def _reduce(table: pa.Table) -> pa.Table:
    """Merge the fragments of some parts."""
    rows, trees = {"open": [], "done": [], "root": []}, {}
    for tree, n, level, i, h in zip(*(table[c].to_pylist() for c in ("tree", "n", "level", "idx", "digest")), strict=True):
        trees.setdefault((tree, n), {})[level, i] = h
    for (tree, n), nodes in trees.items():
        _sort_out(tree, n, *merge(nodes, n=n), rows)
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())])
    return pa.concat_tables([_nodes(r, k, table["part"][0].as_py(), schema) for k, r in rows.items()]).combine_chunks()


NODE = "kind string, part int, tree string, n long, level int, idx long, digest string"


class Forest:
    """The trees over a table of leaves (tree, key, digest, columns to carry). `close` deletes what was written for it."""

    def __init__(self, leaves: DataFrame, key: str = "key"):
        self.key, self.carry = key, [c for c in leaves.columns if c not in ("tree", key, "digest")]
        spark = leaves.sparkSession
        first = cut(leaves, "manifest-leaves")
        count = first.count()
        parts = max(1, min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // PART_ROWS), count))
        # the last key keeps equal rows from meeting in one part; they may stand in any order
        dealt = first.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, "tree", key, "digest", "_row").drop("_row")
        dealt = cut(dealt.withColumn("part", F.spark_partition_id()), "manifest-parts")
        forget(first)
        w = Window.partitionBy("tree")
        segments = dealt.groupBy("part", "tree").agg(F.count("*").alias("m")).withColumns({"_n": F.sum("m").over(w), "_start": F.sum("m").over(w.orderBy("part")) - F.col("m")})
        segments = segments.select(F.col("part").alias("_part"), F.col("tree").alias("_tree"), "_start", "_n")
        schema = f"{NODE}, {', '.join(f'`{c}` {leaves.schema[c].dataType.simpleString()}' for c in (key, *self.carry))}"
        lifted = dealt.groupBy("part").cogroup(segments.groupBy("_part")).applyInArrow(_lift(key, self.carry), schema)
        self.written = [lifted := cut(lifted, "manifest-lifted")]
        self.leaves = lifted.where("kind = 'leaf'")
        now = lifted.where("kind <> 'leaf'").select("kind", "part", "tree", "n", "level", "idx", "digest")
        tables, width = [now], (dealt.agg(F.max("part")).first()[0] or 0) + 1
        forget(dealt)
        while width > 1:
            width = -(-width // FAN)
            fragments = now.where("kind = 'open'").withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
            self.written.append(now := cut(fragments.groupBy("part").applyInArrow(_reduce, NODE), "manifest-merged"))
            tables.append(now)
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        self.folded = every.where("kind = 'done'").select("tree", "level", "idx", "digest")
        self.roots = every.where("kind = 'root'").select("tree", "n", "level", F.col("digest").alias("root"))

    def proofs(self, beyond: DataFrame | None = None) -> DataFrame:
        """key, the carried columns, leaf, subroot, root and proof of every leaf.

        `beyond` (tree, root, proof) continues each tree's proofs above its root.
        """
        key, carry = self.key, self.carry
        top = self.roots.agg(F.max("level")).first()[0] or 0
        base = self.roots.select("tree", F.greatest("level", F.lit(UNIT)).alias("level"), F.lit(0).cast("long").alias("idx"), F.array().cast(f"array<{STEP}>").alias("proof"))
        units = base.where(F.col("level") == top) if top > UNIT else base.where(F.col("level") == UNIT)
        for level in range(top - 1, UNIT - 1, -1):
            runs = self.folded.where(F.col("level") == level).groupBy("tree", F.floor(F.col("idx") / ARITY).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
            # a parent has at most ARITY children, so no key is hot
            above = units.select("tree", F.col("idx").alias("up"), F.col("proof").alias("higher"))
            each = runs.join(above, ["tree", "up"]).select("tree", "run", "higher", F.posexplode("run").alias("at", "node"))
            text = lambda part: F.array_join(F.transform(part, lambda x: x["digest"]), "")
            step = F.struct(text(F.expr("slice(run, 1, at)")).alias("before"), text(F.expr("slice(run, at + 2, size(run))")).alias("after"))
            units = each.select("tree", F.lit(level).alias("level"), F.col("node.idx").alias("idx"), F.concat(F.array(step), "higher").alias("proof")).unionByName(base.where(F.col("level") == level))
        ends = self.roots.select("tree", F.col("root").alias("subroot"))
        ends = ends.join(beyond.select("tree", "root", F.col("proof").alias("beyond")), "tree") if beyond is not None else ends.select("tree", "subroot", F.col("subroot").alias("root"), F.array().cast(f"array<{STEP}>").alias("beyond"))
        units = units.join(ends, "tree").select(F.col("tree").alias("_tree"), F.col("idx").alias("_unit"), "subroot", "root", F.concat("proof", "beyond").alias("higher"))
        rows = self.leaves.select("tree", F.floor(F.col("idx") / ARITY**UNIT).alias("unit"), "idx", "n", "digest", key, *carry)
        kept = ", ".join(f"`{c}` {self.leaves.schema[c].dataType.simpleString()}" for c in (key, *carry))
        return rows.groupBy("tree", "unit").cogroup(units.groupBy("_tree", "_unit")).applyInArrow(_prove(key, carry), f"{kept}, leaf string, subroot string, root string, proof array<{STEP}>")

    def close(self) -> None:
        forget(*self.written)


def _prove(key: str, carry: list[str]):
    """The leaves below one node of level UNIT (or a smaller tree), with their proofs."""
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, [("idx", "ascending")]))
        start, n = left["idx"][0].as_py(), left["n"][0].as_py()
        now, steps = left["digest"].to_pylist(), []
        for _ in range(min(UNIT, len(sizes(n)) - 1)):
            runs = [now[i : i + ARITY] for i in range(0, len(now), ARITY)]
            steps.append([{"before": "".join(r[:k]), "after": "".join(r[k + 1 :])} for r in runs for k in range(len(r))])
            now = [digest("".join(r)) for r in runs]
        higher, m = right["higher"][0].as_py(), left.num_rows
        assert start % ARITY**UNIT == 0 and right.num_rows == 1 and len(now) == 1
        proof = [[s[i // ARITY**k] for k, s in enumerate(steps)] + higher for i in range(m)]
        ends = [pa.array([right[c][0].as_py()] * m, pa.string()) for c in ("subroot", "root")]
        return pa.table([*(left[c] for c in (key, *carry)), left["digest"], *ends, pa.array(proof, kind)], names=[key, *carry, "leaf", "subroot", "root", "proof"])

    return run


def manifest(df: DataFrame, fields: list[str], tree: str, key: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """For each row: key, leaf, subroot, root, proof, and the columns of `carry`, which are expressions over `df`.

    leaf is the digest of `fields`; the leaves of each value of `tree`, by
    ascending `key` (null first, equal keys by leaf), give a subroot, and the
    subroots by value (null first, else by bytes) the root. proof lists, from the
    leaf up to the root, the digests before and after it in its run of siblings;
    `fold` leads from it to the root. Nulls are digested as such, empty and very
    long texts like others; repeated rows are leaves of their own, with places in
    any order. An empty table gives no rows. Columns of `df` that are not named
    are not read, so their names may clash with anything; the names in `carry`
    must differ from the other columns of the result.
    """
    carry = carry or {}
    at = lambda c: F.col(f"`{c}`")
    group = F.when(at(tree).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), at(tree).cast("string")))
    taken = [c for c in ("tree", "key", "digest", "part", "kind", "n", "level", "idx") if c in carry]
    if taken:
        raise ValueError(f"columns to carry must be named otherwise: {', '.join(taken)}")
    low = Forest(df.select(group.alias("tree"), at(key).alias("key"), hashed(fields).alias("digest"), *[e.alias(c) for c, e in carry.items()]))
    high = Forest(low.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("digest")))
    beyond = cut(high.proofs().select(F.col("key").alias("tree"), "root", "proof"), "manifest-beyond")
    high.close()
    return low.proofs(beyond).select(F.col("key").alias(key), *carry, "leaf", "subroot", "root", "proof")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(spark, sf_dir: str) -> DataFrame:
    """Manifest of `documents`; the row's digest after tampering, where it was tampered with, is folded along the proof of the original. A null id is never tampered with."""
    from .common import read

    docs = read(spark, sf_dir, "documents")
    changed = hashed({c: F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS})
    out = manifest(docs, FIELDS, "lang", "doc_id", {"changed": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed)})
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.expr("folded_root = root"))


def oracle(levels: int = 9, top: int = 4) -> str:
    """The same in SQL, for up to 8 ** levels rows of a language and 8 ** top languages: a table a level."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda y: y::BIGINT)), lambda k, u: CASE WHEN k % 2 = 1 THEN xor(k // 2, 3988292384::BIGINT) ELSE k // 2 END)))"
    out = [
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents)",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM d)",
        "l0 AS (SELECT lang, i, n, h FROM p0)",
    ]

    def climb(name: str, group: str, count: int) -> None:
        for k in range(count):
            out.append(f"{name}r{k} AS (SELECT {group}, i // 8 AS i, n, list(h ORDER BY i) AS run FROM {name}{k} GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS (SELECT {group}, i, CAST(ceil(n / 8) AS BIGINT) AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {name}r{k})")

    climb("l", "lang", levels)
    out.append(f"tt AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM l{levels}), t0 AS (SELECT 1 AS one, i, n, h FROM tt)")
    climb("t", "one", top)
    step = lambda run, at: (f"array_to_string({run}[1:{at} % 8], '')", f"array_to_string({run}[{at} % 8 + 2:], '')")
    joins, befores, afters, ons = [], [], [], []
    for k in range(levels):
        b, a = step(f"l{k}x.run", f"(i0 // {8**k})")
        joins.append(f"JOIN lr{k} l{k}x ON l{k}x.lang IS NOT DISTINCT FROM q.lang AND l{k}x.i = q.i0 // {8 ** (k + 1)}")
        befores.append(b), afters.append(a), ons.append(f"l{k}x.n > 1")
    for k in range(top):
        b, a = step(f"t{k}x.run", f"(j // {8**k})")
        joins.append(f"JOIN tr{k} t{k}x ON t{k}x.i = q.j // {8 ** (k + 1)}")
        befores.append(b), afters.append(a), ons.append(f"t{k}x.n > 1")
    steps = ", ".join(f"struct_pack(b := {b}, a := {a}, u := {on})" for b, a, on in zip(befores, afters, ons, strict=True))
    out.append(f"q AS (SELECT p0.doc_id, p0.lang, p0.leaf, coalesce(p0.changed, p0.leaf) AS used, p0.i AS i0, tt.i AS j, tt.h AS subroot, t{top}.h AS root FROM p0 JOIN tt ON p0.lang IS NOT DISTINCT FROM tt.lang, t{top})")
    out.append(f"s AS (SELECT doc_id, leaf, used, subroot, root, list_filter([{steps}], lambda x: x.u) AS proof FROM q {' '.join(joins)})")
    folded = "list_reduce(list_prepend(struct_pack(b := '', a := '', u := true, h := used), list_transform(proof, lambda x: struct_pack(b := x.b, a := x.a, u := true, h := ''))), lambda x, y: struct_pack(b := '', a := '', u := true, h := sha256(y.b || x.h || y.a))).h"
    return f"WITH {', '.join(out)}\nSELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda x: x.b || x.a), '')) AS proof_sha256, {folded} AS folded_root, {folded} = root AS verified FROM s"
