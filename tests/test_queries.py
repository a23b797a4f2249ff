"""Every registered query of the web-clip operators against its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from quillmill.plans.registry import everything

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = everything()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canon(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v.item() if hasattr(v, "item") else v)

    return sorted(tuple(map(one, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_query_equals_sql(spark, duck, name):
    ours = REGISTRY.queries[name](spark, SF).toPandas()
    theirs = duck.execute(REGISTRY.sql[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)
