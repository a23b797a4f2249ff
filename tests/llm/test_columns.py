"""Every operator and stage that keeps columns, with columns named like what operators use inside; and odd tables through the pipeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import jaccard, simhash
from quillmill.llm.decontaminate import keep_clean, mark
from quillmill.llm.mixing import mix, mixture
from quillmill.llm.quality import QualityModel, keep_good, score_texts
from quillmill.llm.sharding import shard_stored

from .cases import documents

CLASHING = ["weight", "plan", "row_number", "rows_total", "_id", "_found", "_digest", "_block", "_part", "_source", "of_source", "score", "predicted", "n_words", "n_hit", "contaminated", "position", "slot", "file", "local", "before", "k1", "own_1", "in_0", "stays", "mix_rank", "component_id", "fp"]
SF = "/root/testdata/sf0.001"


def clashing(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    return docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in CLASHING])


def values(df, but=()):
    columns = [c for c in ["doc_id", "text", "lang", "source", "n_chars", *CLASHING] if c not in but]
    return {tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()}


FLAT = QualityModel((b"good", b"bad"), 0.0, 1.0)
OPERATORS = {
    "score_texts": (lambda d, s: score_texts(d, FLAT), {"score", "predicted"}),
    "keep_good": (lambda d, s: keep_good(d, FLAT), set()),
    "keep_one_simhash": (lambda d, s: simhash.keep_one(d), set()),
    "keep_one_jaccard": (lambda d, s: jaccard.keep_one(d), set()),
    "mark": (lambda d, s: mark(d, s.read.parquet(f"{SF}/benchmark.parquet")), {"n_words", "n_hit", "contaminated"}),
    "keep_clean": (lambda d, s: keep_clean(d, s.read.parquet(f"{SF}/benchmark.parquet")), set()),
    "mix": (lambda d, s: mix(d, block_rows=2, period=8), {"mix_rank"}),
    "mixture": (lambda d, s: mixture(d, block_rows=2, period=8), set()),
    "shard_stored": (lambda d, s: shard_stored(d, shards=3), {"row_number", "position", "slot"}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_stay_as_they_are(spark, name):
    docs = clashing(spark)
    run, replaced = OPERATORS[name]
    out = run(docs, spark)
    assert set(docs.columns) <= set(out.columns)
    assert values(out, replaced) <= values(docs, replaced)
    if not name.startswith("keep"):
        assert out.count() == docs.count()


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    clashing(spark).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and values(out) <= values(docs)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    docs = documents(spark)
    (docs if rows == "odd" else docs.limit(0)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r["doc_id"] for r in out]
    assert len(kept) == len(set(kept)) and sorted(r["shard"] for r in out) == sorted(i % 40 for i in range(len(out)))
    if rows == "none":
        assert not out
    else:
        assert not {2} & set(kept)  # a copy of 1


def test_stored_places_in_a_partitioned_table(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), (F.col("id") % 4).alias("p"))
    rows.repartition(6, "doc_id").write.partitionBy("p").parquet(str(tmp_path / "t"))
    out = shard_stored(spark.read.parquet(str(tmp_path / "t")), shards=7).collect()
    assert sorted(r["row_number"] for r in out) == sorted(r["position"] for r in out) == list(range(1000))
    assert sorted((r["slot"], r["shard"]) for r in out) == [(i // 7, i % 7) for i in range(1000)]


def test_part_files_in_the_order_of_their_numbers(spark, tmp_path):
    for i, n in enumerate(["part-99999-a.parquet", "part-100000-a.parquet", "part-00007-a.parquet"]):
        spark.createDataFrame([(i, f"t{i}")], "doc_id long, text string").toPandas().to_parquet(str(tmp_path / n))
    out = {r["doc_id"]: r["row_number"] for r in shard_stored(spark.read.parquet(str(tmp_path)), shards=2).collect()}
    assert out == {2: 0, 0: 1, 1: 2}
