from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm.mixing import mix

from .cases import documents


@pytest.mark.parametrize("weights", [None, {"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 1.0}])
def test_less_than_one_block_away(spark, weights):
    sizes = {"a": 400, "b": 150, "c": 60, None: 25}
    rows = [(i, f"t{i}", "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    out = mix(documents(spark, rows), weights, block_rows=4, period=20).toPandas()
    assert sorted(out.doc_id) == [r[0] for r in rows]
    blocks = out.groupby("mix_block").agg(n=("doc_id", "size"), sources=("source", lambda s: s.nunique(dropna=False)), source=("source", "first"), phase=("mix_phase", "first"))
    assert blocks.index.tolist() == list(range(len(blocks))) and blocks.n.max() == 4 and blocks.sources.max() == 1
    first = blocks[blocks.phase == 0].source.fillna("-")
    for source, weight in out.assign(source=out.source.fillna("-")).groupby("source").mix_weight.first().items():
        given = np.cumsum((first == source).to_numpy())
        assert np.abs(given - weight * np.arange(1, len(first) + 1)).max() < 1


def test_odd_rows(spark):
    docs = documents(spark)
    out = mix(docs, block_rows=2, period=8)
    assert out.count() == docs.count()
    assert set(out.columns) == {*docs.columns, "mix_weight", "mix_phase", "mix_block", "mix_rank"}
    assert mix(docs.limit(0)).count() == 0
    again = mix(docs.repartition(5), block_rows=2, period=8)
    key = lambda df: sorted(map(str, df.select("doc_id", "mix_block", "mix_rank").collect()))
    assert key(out) == key(again)


def test_only_native_operators(spark):
    plan = mix(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert F.__name__ == "pyspark.sql.functions"
