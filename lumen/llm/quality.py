"""Quality scores by co-training.

Two views of a document, its text content and its page metadata, each have a
logistic classifier. Both start from the labelled documents; round by round,
each labels the unlabelled documents that it is confident of, and the other one
is fitted again with those labels added. In the end a calibrator, fitted on
labelled documents that neither view has learned from, combines the two logits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDS, cut, fold
from .jaccard_join import word_hashes

ROUNDS = 2
#: A view labels a document for the other one from this probability of either label.
CONFIDENT = 0.98
#: Labelled documents of this fold fit the calibrator; fold 0 is held out of everything.
CALIBRATION_FOLD = 1
#: One-hot places of hashed sources and languages.
SOURCES, LANGS = 32, 8
N_TEXT = 14
_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 sentence punctuation, 5 space, 6 line end, 7 other symbols, 8 beyond ASCII
_KIND[33:127] = 7
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[[9, 32]], _KIND[[10, 13]] = 5, 6
_KIND[128:] = 8


def text_features(text: str | None) -> np.ndarray:
    """Content measures of a whole text; zeros for a null or empty one."""
    out = np.zeros(N_TEXT, np.float32)
    if not text:
        return out
    share = np.bincount(_KIND[np.frombuffer(text.encode(), np.uint8)], minlength=9)[:9] / len(text)
    w = word_hashes(text)
    n = len(w)
    out[0] = 1
    out[1:8] = share[[2, 3, 4, 5, 6, 7, 8]]
    if n:
        out[8] = len(np.unique(w)) / n
        out[9] = np.log1p(n)
        out[10] = len(text) / n / 10
        out[11] = np.mean(w[1:] == w[:-1]) if n > 1 else 0
        pairs = w[1:] * np.uint64(0x9E3779B97F4A7C15) + w[:-1]
        out[12] = len(np.unique(pairs)) / len(pairs) if n > 1 else 1
    lines = text.split("\n")
    out[13] = len(set(lines)) / len(lines)
    return out


def _text_view(docs: DataFrame) -> DataFrame:
    """`docs` with `_text` replaced by the array `_tv`."""
    rest = [c for c in docs.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t.as_py()) for t in batch.column(batch.num_columns - 1)], np.float32).reshape(-1, N_TEXT)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_TEXT).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names=[*rest, "_tv"])

    chosen = docs.select(*rest, "_text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{fields}, _tv array<float>")


def _one_hot(c: Column, n: int) -> Column:
    at = F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))), F.lit(n)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (at == i).cast("float"))


def _meta_view(docs: DataFrame, text: Column) -> Column:
    """Array of metadata measures; columns that the table lacks count as null."""
    col = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    n = F.coalesce(F.length(text), F.lit(0)).cast("float")
    size = F.coalesce(col("n_chars").try_cast("float"), n)
    lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("float")
    return F.concat(F.array(F.log1p(F.greatest(size, F.lit(0.0))).cast("float"), F.log1p(lines).cast("float"), (size / lines / 100).cast("float"), (F.abs(size - n) > 0).cast("float")), _one_hot(col("source"), SOURCES), _one_hot(col("lang"), LANGS))


def _logit(p: Column) -> Column:
    return F.log((p + 1e-6) / (1 - p + 1e-6))


def score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, p_text, p_meta, score (0 to 1), keep (score >= 0.5).

    `labels` has doc_id and quality (0 or 1; other values and nulls teach
    nothing; of several labels of one id the lowest counts). Pseudo-labels come
    from all unlabelled documents, whatever their number; both classifiers are
    fitted by distributed jobs. Null and empty texts have a text view of zeros;
    repeated rows get equal scores; null ids are scored and never learned from.
    With labels of one kind only, or none, every score is that kind's share (0.5
    for none). An empty table gives none. Texts are scored whole, very long ones
    too. Columns beside those of `documents` are not read and may have any name.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_lid")).agg(F.min("quality").cast("double").alias("_y"))
    text = F.col("text")
    rows = docs.select(F.col("doc_id"), _meta_view(docs, text).alias("_mv"), fold(F.col("doc_id")).alias("_fold"), text.alias("_text"))
    # labels are joined to the features, not to the texts
    seen = _text_view(rows)
    seen = cut(seen.join(known, seen["doc_id"] == known["_lid"], "left").drop("_lid"), "quality-views")
    teach = F.col("_y").isNotNull() & (F.col("_fold") > CALIBRATION_FOLD)
    counts = {r["_y"]: r["n"] for r in seen.where(teach).groupBy("_y").agg(F.count("*").alias("n")).collect()}
    held = F.coalesce(F.col("_fold") == 0, F.lit(False)).alias("held_out")
    if len(counts) < 2:
        share = F.lit(next(iter(counts), 0.5))
        return seen.select("doc_id", held, share.alias("p_text"), share.alias("p_meta"), share.alias("score"), (share >= 0.5).alias("keep"))
    views = {"text": "_tv", "meta": "_mv"}
    data = seen.select("doc_id", "_y", "_fold", *[array_to_vector(c).alias(c) for c in views.values()])

    def learn(rows_: DataFrame, view: str, label: Column):
        # a null label drops the row; pseudo-labels weigh less than labels
        used = rows_.select(views[view], label.alias("_l"), F.when(teach, 1.0).otherwise(0.3).alias("_w")).where("_l is not null")
        lr = LogisticRegression(featuresCol=views[view], labelCol="_l", weightCol="_w", predictionCol=f"o_{view}", rawPredictionCol=f"r_{view}", probabilityCol=f"q_{view}", regParam=1e-3, maxIter=30)
        return lr.fit(used)

    def with_p(models: dict) -> DataFrame:
        out = data
        for view, model in models.items():
            out = model.transform(out).withColumn(f"p_{view}", vector_to_array(f"q_{view}")[1]).drop(f"q_{view}", f"r_{view}", f"o_{view}")
        return out

    own = F.when(teach, F.col("_y"))
    models = {v: learn(data, v, own) for v in views}
    unlabelled = F.col("_y").isNull() & F.coalesce(F.col("_fold") > 0, F.lit(False))
    for _ in range(rounds):
        scored = with_p(models)
        sure = {v: F.when(unlabelled & (F.col(f"p_{v}") >= CONFIDENT), 1.0).when(unlabelled & (F.col(f"p_{v}") <= 1 - CONFIDENT), 0.0) for v in views}
        models = {"text": learn(scored, "text", F.coalesce(own, sure["meta"])), "meta": learn(scored, "meta", F.coalesce(own, sure["text"]))}
    final = with_p(models)
    logits = final.withColumn("_z", F.array(_logit(F.col("p_text")), _logit(F.col("p_meta")))).withColumn("_z", array_to_vector("_z"))
    spare = logits.where(F.col("_y").isNotNull() & (F.col("_fold") == CALIBRATION_FOLD))
    spare = spare if spare.select("_y").distinct().count() == 2 else logits.where(teach)
    calibrator = LogisticRegression(featuresCol="_z", labelCol="_y", predictionCol="_o", rawPredictionCol="_r", probabilityCol="_q", regParam=1e-3, maxIter=30).fit(spare.select("_z", "_y"))
    out = calibrator.transform(logits).withColumn("score", vector_to_array("_q")[1])
    return out.select("doc_id", held, "p_text", "p_meta", "score", (F.col("score") >= 0.5).alias("keep"))


assert FOLDS > CALIBRATION_FOLD + 1


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
