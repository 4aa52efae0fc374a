"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table:
slot(i) = (offset + i * skip) mod size, offset and skip taken from md5 of its
name. The shards take turns and each claims its best free slot until the table
is full, so no two shards differ by more than one slot, and removing a shard
moves little besides its own slots. The table, whose size is a parameter, is
broadcast; placing a row is a hash and one lookup.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters of the query: a prime of at least 100 slots a shard.
SHARDS = [f"shard-{i:03d}" for i in range(64)]
TABLE_SIZE = 16381


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Index into `shards` for each slot. `size` must be prime and not below the number of shards; names must differ."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and named differently")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime and at least the number of shards")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    table = np.full(size, -1, dtype=np.int32)
    at = list(offset)
    left = size
    while left:
        for s in range(len(shards)):
            slot = at[s]
            while table[slot] >= 0:
                slot = (slot + skip[s]) % size
            table[slot] = s
            at[s] = (slot + skip[s]) % size
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """First 32 bits of md5(key as text), mod the table size; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % size


def place(df: DataFrame, key: str, shards: list[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """`df` with `slot` and `shard` (columns of those names are replaced).

    Equal keys, repeated rows included, go to one shard; null keys go where the
    empty text goes; an empty table stays empty. No row is moved or dropped. The
    broadcast side has exactly `size` rows whatever the input is.
    """
    table = lookup_table(shards, size)
    slots = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "slot long, shard string")
    rest = df.drop("slot", "shard")
    return rest.withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(slots), "slot", "left").select(*rest.columns, "slot", "shard")


def query(spark, sf_dir: str) -> DataFrame:
    """Place every document by doc_id: doc_id, slot, shard."""
    from .common import read

    return place(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def oracle() -> str:
    """The same placement in SQL; the table is written out, as SQL has no turn-taking."""
    table = ",".join(map(str, lookup_table(SHARDS, TABLE_SIZE).tolist()))
    return f"""
WITH t AS (SELECT [{table}] AS owner),
k AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 3, '0') AS shard FROM k, t
"""
