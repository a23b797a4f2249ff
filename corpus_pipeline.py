"""The corpus pipeline: documents in; good, single, uncontaminated, mixed and sharded documents out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm._util import forget, read, shared_dir, small_batches
from quillmill.llm.decontaminate import keep_clean
from quillmill.llm.jaccard import keep_one
from quillmill.llm.langid import held_out
from quillmill.llm.mixing import mixture
from quillmill.llm.quality import keep_good, train
from quillmill.llm.sharding import shard_stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels as in op7, not from held-out ones."""
    small_batches(spark)
    labels = read(spark, sf_dir, "labels")
    model = train(read(spark, sf_dir, "documents"), labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return keep_good(docs, model, threshold=0.3)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest doc_id: SimHash fingerprints of five-word shingles pair documents,
    whole sets confirm a Jaccard similarity of 0.8 or more, and an exact join adds the links that fingerprints are too far apart for."""
    small_batches(spark)
    return keep_one(docs, words=5, similarity=(4, 5))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all words of a shorter one, go."""
    small_batches(spark)
    return keep_clean(docs, read(spark, sf_dir, "benchmark"), words=10)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mixture: reading the files in turn holds the target weights."""
    return mixture(docs, block_rows=32, period=256)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot; the row numbers that are permuted are the places in the stored mixture."""
    return shard_stored(docs, shards=40)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", single),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: SQL can't express the compressed sizes of the first stage, and so not the rows of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; what a stage kept is written to the shared folder for the next."""
    shared_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                forget(spark, f"{folder}/{i - 1}")
    return docs
