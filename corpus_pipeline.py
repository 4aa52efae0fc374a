"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import decontamination, jaccard_join, language_id, packing, pii
from lumen.llm.common import cut, forget, held_out, leaving_nothing, plain_names, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised, with `lang` as predicted. The model is fitted on the stage's own labelled documents.

    Null texts and texts without a letter are in no language and go; null ids and
    repeated rows stay. Columns beside those of `documents` may have any name.
    With no labelled row nothing is recognised; an empty table stays empty.
    """
    safe, at = plain_names(docs)
    teach = docs.select("doc_id", "text", "lang")
    model = language_id.fit(teach.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    rest = tuple(c for c in safe.columns if c not in (at["doc_id"], at["lang"]))
    out = language_id.predict(safe, model, at["doc_id"], at["text"], keep=rest).where(~F.col("rejected"))
    renamed = {at["doc_id"]: F.col("doc_id"), at["lang"]: F.col("lang_pred")}
    return out.select(*[renamed.get(c, F.col(c)).alias(c) for c in safe.columns]).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near copies (see `jaccard_join.keep_one` for ties, null ids and repeated rows); rows without words stay."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that repeat benchmark passages; null and empty texts are clean, and an empty benchmark drops nothing."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; n_chars, if there, follows the text.

    Every row stays; null and empty texts too, with the n_chars that they had if
    null. Columns beside those of `documents` may have any name.
    """
    safe, at = plain_names(docs)
    out = pii.replace(safe, id_col=at["doc_id"], text_col=at["text"]).drop("n_entities")
    if "n_chars" in at:
        n, text = at["n_chars"], F.col(at["text"])
        out = out.withColumn(n, F.when(text.isNull(), F.col(n)).otherwise(F.length(text)).cast(safe.schema[n].dataType))
    return out.select(*safe.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with their token ids; a null or empty text is one piece of the end id, an empty table has none."""
    return packing.pack(docs, ids=True)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", replace_private),
    ("packing", pack),
]

#: Minhash, keyed surrogates and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between two stages the table is written to the shared folder and read again. Of what they write there only the last stage's input is left."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with leaving_nothing():
            docs = cut(stage(spark, before, sf_dir), f"stage-{name.replace(' ', '-')}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
