from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from quillmill.llm import _util

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    before = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < len(rows) < before.count() and rows.doc_id.is_unique
    assert set(before.columns) <= set(rows.columns)
    counts = rows.groupby("shard").slot.agg(["count", "min", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] + 1 == counts["count"]).all()
    assert not rows.text.duplicated().any()


def test_each_stage_keeps_columns_and_clean_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = out.count()
        assert kept >= 0.6 * docs.count()
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))


def test_texts_go_to_python_in_small_batches(spark):
    """Buffers for up to 64 MB of text lay outside the executors' heap, in the JVM and in each Python worker."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("words "), 2000).alias("text"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        spark.conf.unset(_util.BATCH_SETTING)
        stage(spark, docs, SF)
        most, n = long.mapInArrow(sizes, "size long").agg(F.max("size"), F.count("size")).first()
        assert most < 2 * _util.BYTES_A_BATCH and n > 4
    spark.conf.set(_util.BATCH_SETTING, "1000000")
    _util.small_batches(spark)
    assert spark.conf.get(_util.BATCH_SETTING) == "1000000"
    spark.conf.unset(_util.BATCH_SETTING)


def test_entry_without_the_corpus_part(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "corpus_queries", None)
    assert "pipeline" not in __spark_entry__.queries() and "clip_stats" in __spark_entry__.queries()
