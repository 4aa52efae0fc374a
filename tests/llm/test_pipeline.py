from __future__ import annotations

import os
import random

import corpus_pipeline
import pytest
from lumen.llm import common, language_id, packing
from lumen.llm.common import held_out
from pyspark.sql import functions as F

from .test_copies import brute_join, brute_scan
from .test_texts import FOUND
from .util import odd_documents, prose


def test_stages_do_their_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, corpus_pipeline.cut(stage(spark, rows, sf_dir), "test-stage")
        assert rows.columns == docs.columns
        was, now = ({r["doc_id"]: r for r in t.collect()} for t in (before, rows))
        if name == "language ID":
            # the nearest centroid, row by row
            model = language_id.fit(before.where(~held_out(F.col("doc_id"))))
            want = {}
            for i, r in was.items():
                raw = language_id.letters(r["text"])
                if raw:
                    cos = (language_id.vectors([raw], model["idf"]) @ model["centroids"].T)[0]
                    j = int(cos.argmax())
                    if cos[j] >= language_id.REJECT_AT * model["least"][j] * min(1.0, len(raw) / language_id.FULL) ** 0.5:
                        want[i] = model["lang"][j]
            assert {i: r["lang"] for i, r in now.items()} == want
        if name == "near duplicates":
            assert sorted(now) == sorted(r[0] for r in brute_join([(i, r["text"]) for i, r in was.items()]) if r[0] == r[1])
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert sorted(now) == sorted(r[0] for r in brute_scan([(i, r["text"]) for i, r in was.items()], items) if not r[4]) != sorted(was)
        if name == "personal data":
            assert now.keys() == was.keys()
            seen: dict[str, str] = {}
            for i, r in was.items():
                a, b = FOUND.findall(r["text"]), FOUND.findall(now[i]["text"])
                assert len(a) == len(b) and now[i]["n_chars"] == len(now[i]["text"])
                assert all(seen.setdefault(x, y) == y != x for x, y in zip(a, b, strict=True))
    packed = corpus_pipeline.run(spark, sf_dir)
    want = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.pack(rows).collect()}
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packed.collect()} == want


def test_odd_rows_and_clashing_names(spark, tmp_path):
    rng = random.Random(2)
    odd = [(*d, "en", "s", 5) for d in odd_documents(rng)] + [(i, prose(rng, 40) + " mail me at a@b.org", "en", None, None) for i in range(20, 40)]
    more = "score double, rejected string, lang_pred string, n_entities int, spans int, items string, contaminated int, ck int, root int, keep_id int, c0 int, h int, _t int"
    names = [x.split()[0] for x in more.split(", ")]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(3).cast(x.split()[1]).alias(x.split()[0]) for x in more.split(", ")])
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(13)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.cut(stage(spark, rows, str(tmp_path)), "test-stage")
        assert rows.columns == df.columns
        assert rows.select(*[F.count_if(F.col(n).isNull() | (F.col(n).cast("string") != F.col(n).cast("string"))) for n in names]).first()[0] == 0
    ids = [r["doc_id"] for r in rows.collect()]
    # words without a letter, empty and null texts are in no language; repeated rows are one
    assert {3, 4, 6} & set(ids) == set() and ids.count(2) == 0 and ids.count(1) == 1 and set(range(20, 40)) <= set(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() > 0


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "s", 3), (None, "", None, None, None)]])
def test_empty_documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_table_is_left_but_the_last_one(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    corpus_pipeline.run(spark, sf_dir).count()
    assert [x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)] == ["stage-personal-data"]
