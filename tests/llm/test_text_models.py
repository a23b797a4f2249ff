"""Language and quality by compression: held-out accuracy and odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmill.llm import langid, quality
from quillmill.llm._compress import Sizer, dictionary

from .cases import documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_dictionary_is_bounded():
    texts = ["abc " * 1000, "x", "", "y" * 5000]
    assert 0 < len(dictionary(texts, 2000)) <= 2000
    assert dictionary([], 100) == b""


def test_long_texts_are_judged_whole():
    sizer = Sizer([b"aaaa bbbb cccc " * 50, b"dddd eeee ffff " * 50])
    n, sizes = sizer.sizes("zz " * 3000 + "dddd eeee ffff " * 400)
    assert n == 15000 and sizes[1] < sizes[0]


def test_languages_held_out(docs):
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~out))
    rows = langid.identify(docs.where(out), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97
    sure = rows[rows.accepted]
    assert (sure.lang_pred == sure.lang).mean() >= (rows.lang_pred == rows.lang).mean()
    assert rows.score.between(0, 1).all()


def test_language_of_odd_rows(spark, docs):
    model = langid.train(docs)
    rows = langid.identify(documents(spark), model).collect()
    assert len(rows) == 12
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {3, 4, 6, 10}
    assert langid.identify(documents(spark).limit(0), model).count() == 0
    nothing = langid.train(documents(spark).where("lang = 'none'"))
    assert {r["lang_pred"] for r in langid.identify(documents(spark), nothing).collect()} == {"und"}


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = langid.held_out(F.col("doc_id"), 5, 0)
    model = quality.train(docs, labels.where(~out))
    rows = quality.score_texts(docs.where(out), model).join(labels, "doc_id").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.93
    assert rows[rows.quality == 1].predicted.mean() > 0.97
    assert rows[rows.quality == 0].score.mean() < 0.4 < rows[rows.quality == 1].score.mean()


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 0, 1), (7, 0, 0), (7, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    model = quality.train(docs, labels)
    out = quality.score_texts(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    rows = out.collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    flat = quality.train(docs, labels.where("quality = 1"))
    assert {round(r["score"], 3) for r in quality.score_texts(docs, flat).collect()} == {0.999}
    assert {r["score"] for r in quality.score_texts(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score_texts(docs.limit(0), model).count() == 0
