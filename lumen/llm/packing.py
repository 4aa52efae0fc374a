"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of `max_len` tokens while it has that
many, and the rest into pieces whose lengths are the binary digits of what is
left, longest first. A piece is a sequence of its own, so no sequence holds two
documents and none is padded. `bucket` names the length that a reader batches it
by (partitionBy("bucket") on writing gives a folder a length); the operator
itself moves nothing, as a shuffle by a dozen lengths would only skew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEN = 1024
#: The id that ends each document.
END_ID = 0
#: Vocabulary files of the public tokenizers, found by name.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"


def cuts(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Piece lengths of a document of n tokens, in order; each a power of two (`max_len` too)."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


class Encoder:
    """Ids of a text by the byte-level vocabulary, as the tokenizers library gives them.

    Texts without a special token go through the rank file of the same
    vocabulary, which gives the same ids several times faster; the others go
    through the tokenizers library itself.
    """

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.path = tokenizer or public_tokenizers.path(TOKENIZER)
        with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.full = None

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if SPECIAL in text:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.path)
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoder: Encoder | None = None


def encoder() -> Encoder:
    """One a worker process."""
    global _encoder
    if _encoder is None:
        _encoder = Encoder()
    return _encoder


def pack(docs: DataFrame, max_len: int = MAX_LEN, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, and `ids` if asked for.

    Each text is encoded whole and END_ID is appended; a null or empty text is
    that one id. Rows are independent, so repeated rows and null ids give pieces
    of their own, and an empty table gives none. Other columns are not read. No
    shuffle: sequence_id comes from the partition and the row's place in it.
    `max_len` must be a power of two.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            step = 256
            for lo in range(0, batch.num_rows, step):
                owner, piece, start, length, crc, total, flat = [], [], [], [], [], [], []
                for i, text in enumerate(texts.slice(lo, step)):
                    got = encode(text.as_py())
                    arr = np.empty(len(got) + 1, dtype="<u4")
                    arr[:-1] = got
                    arr[-1] = END_ID
                    raw, at, n = memoryview(arr.tobytes()), 0, len(arr)
                    for k, size in enumerate(cuts(n, max_len)):
                        owner.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        total.append(n)
                        at += size
                    if ids:
                        flat.append(arr)
                cols = [keys.slice(lo, step).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc, total))]
                if ids:
                    values = np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length, dtype=np.int64)]).astype(np.int32)), pa.array(values)))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length").cast("int")})


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return pack(read(spark, sf_dir, "documents"))
