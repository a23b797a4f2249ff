from __future__ import annotations

import zlib

import numpy as np
import pytest

from quillmill.llm.sharding import permute, shard_documents, shard_stored

from .cases import documents


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation(n):
    out = permute(np.arange(n), n, 5)
    assert sorted(out) == list(range(n))
    assert n < 60 or not (out == np.arange(n)).all()
    assert (permute(np.arange(n)[::-1], n, 5) == out[::-1]).all()


def test_law_holds(spark):
    docs = documents(spark)
    out = shard_documents(docs, shards=5).toPandas()
    assert len(out) == docs.count()
    counts = out.groupby("shard").slot.agg(["count", "min", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in out.itertuples():
        text = texts[None if r.doc_id != r.doc_id else int(r.doc_id)].encode()
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text))


def test_layout_does_not_matter(spark):
    docs = documents(spark)
    key = lambda df: sorted(map(str, df.select("doc_id", "shard", "slot").collect()))
    assert key(shard_documents(docs.repartition(1), 4)) == key(shard_documents(docs.repartition(7, "text"), 4))


def test_stored_order_is_the_row_number(spark, tmp_path):
    spark.range(0, 100, 1, 3).selectExpr("id AS doc_id", "'t' AS text", "5 AS slot").write.parquet(str(tmp_path / "d"))
    out = shard_stored(spark.read.parquet(str(tmp_path / "d")), 7).toPandas()
    assert (out.row_number == out.doc_id).all()
    assert (out.position == permute(out.row_number.to_numpy(), 100, 42)).all()
    assert shard_stored(documents(spark), 3).count() == documents(spark).count()


def test_empty(spark):
    assert shard_documents(documents(spark).limit(0)).count() == 0
