"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is lower-cased; the byte 2- and 3-grams of its letters (UTF-8, words
separated by one space) are hashed to DIM features, weighted by
log(1 + tf) * idf and normalised. Every language has several centroids, found
by spherical k-means over its labelled texts. A text gets the language of the
centroid with the highest cosine, and is rejected if it is farther away than
the texts of that language ever were by a margin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1 << 13
CENTROIDS = 4
#: Labelled texts a language that the centroids are fitted on (those with the smallest hash of their id); idf comes from all of them.
FIT_ROWS = 1500
#: Rejected below this share of the 1st percentile of the fitted texts' cosines; texts of fewer letters than FULL have fewer n-grams to share, so the bar falls with the root of their length.
REJECT_AT, FULL = 0.5, 400
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_CHUNK = 1 << 22  # bytes of text handled at once


def letters(text: str | None) -> bytes:
    """Lower-cased letters of a text, its words between single spaces; empty if it has no letter."""
    if not text:
        return b""
    out = _OTHER.sub(" ", text.lower()).strip()
    if out and not out.replace(" ", "").isalpha():  # numerals that are no digits: fractions, circled numbers
        out = " ".join("".join(c if c.isalpha() else " " for c in out).split())
    return f" {out} ".encode() if out else b""


def counts(texts: list[bytes]) -> np.ndarray:
    """Texts x DIM matrix of n-gram counts."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i in range(0, len(texts)):
        raw = texts[i]
        if len(raw) < 3:
            continue
        for lo in range(0, len(raw) - 1, _CHUNK):
            b = np.frombuffer(raw, np.uint8, count=min(len(raw) - lo, _CHUNK + 2), offset=lo).astype(np.uint32)
            two = b[:-1] * np.uint32(256) + b[1:]
            three = two[:-1] * np.uint32(256) + b[2:]
            code = np.concatenate([two[:_CHUNK] + np.uint32(1 << 25), three[:_CHUNK]]) * np.uint32(2654435761) >> np.uint32(32 - 13)
            out[i] += np.bincount(code, minlength=DIM)
    return out


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts(texts)) * idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean direction, each next the text farthest from those there are."""
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)
    centres = unit(x.mean(axis=0))[None]
    while len(centres) < min(k, len(x)):
        far = (x @ centres.T).max(axis=1)
        if far.min() > 1 - 1e-9:
            break
        # the tenth percentile rather than the outermost text, which may be junk
        centres = np.vstack([centres, x[np.argsort(far, kind="stable")[len(far) // 10]]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        new = np.array([unit(x[own == j].mean(axis=0)) if (own == j).any() else centres[j] for j in range(len(centres))])
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres.astype(np.float32)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of each feature, over all rows of column `text`, and the number of texts with a letter. The result has DIM rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in _batches(batches):
            has = [t for t in (letters(x.as_py()) for x in batch.column(0)) if t]
            if has:
                df += (counts(has) > 0).sum(axis=0)
                n += len(has)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIM), -1)), pa.array(np.append(df, n))], names=["feature", "n"])

    rows = texts.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    got = {r["feature"]: r["n"] for r in rows}
    return np.array([got.get(i, 0) for i in range(DIM)], np.float64), got.get(-1, 0)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """A model of the languages in `labelled` (doc_id, text, lang).

    Rows with a null language or without a letter teach nothing. idf is taken
    over all rows; the centroids of a language over `fit_rows` of its rows,
    chosen by hash. Languages are counted first; the number of rows gathered in
    one task is at most about `fit_rows`.
    """
    known = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequency(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    idf[df == 0] = 0
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, size in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, fit_rows / size))).otherwise(share)
    hashed = (F.pmod(F.xxhash64(F.col("doc_id"), F.crc32("text")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    sample = known.where(hashed < share).select("lang", "text")
    shared = known.sparkSession.sparkContext.broadcast(idf)
    schema = pa.schema([("lang", pa.string()), ("centroid", pa.list_(pa.float32())), ("least", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        has = sorted(t for t in (letters(x.as_py()) for x in table["text"]) if t)
        if not has:
            return schema.empty_table()
        x = np.vstack([vectors(has[a : a + 256], shared.value) for a in range(0, len(has), 256)])
        centres = cluster(x)
        least = float(np.quantile((x @ centres.T).max(axis=1), 0.01))
        return pa.table([pa.array([table["lang"][0].as_py()] * len(centres)), pa.array(list(centres), pa.list_(pa.float32())), pa.array([least] * len(centres))], schema=schema)

    rows = sorted(sample.groupBy("lang").applyInArrow(run, "lang string, centroid array<float>, least double").collect(), key=lambda r: (r["lang"], r["centroid"]))
    return {"idf": idf, "lang": [r["lang"] for r in rows], "least": np.array([r["least"] for r in rows]), "centroids": np.array([r["centroid"] for r in rows], np.float32).reshape(-1, DIM)}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, `keep`, lang_pred, score (highest cosine, 0 to 1), rejected.

    Whole texts. Null texts, texts without a letter, and any text if the model
    knows no language: `und`, score 0, rejected. A rejected text otherwise
    keeps its nearest language, with `rejected` true. Ties go to the first
    language by name. Rows are independent: repeated rows get equal results, null
    ids are ids like others, an empty table stays empty. Of `docs` only the id,
    the text and `keep` are read; a column of `keep` may not have a name of the
    result. Letters are what `str.isalpha` says: fractions, circled and other
    numerals are none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in _batches(batches):
            raw = [letters(t.as_py()) for t in batch.column(0)]
            lang, score, rejected = [UNKNOWN] * len(raw), np.zeros(len(raw)), np.ones(len(raw), bool)
            at = [i for i, t in enumerate(raw) if t]
            if at and m["lang"]:
                cos = vectors([raw[i] for i in at], m["idf"]) @ m["centroids"].T
                near = cos.argmax(axis=1)
                for i, j, c in zip(at, near, cos.max(axis=1), strict=True):
                    lang[i], score[i], rejected[i] = m["lang"][j], min(1.0, max(0.0, float(c))), c < REJECT_AT * m["least"][j] * min(1.0, len(raw[i]) / FULL) ** 0.5
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang), pa.array(score), pa.array(rejected)], names=names)

    chosen = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *keep)
    names = [*chosen.columns[1:], "lang_pred", "score", "rejected"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import held_out, read

    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
