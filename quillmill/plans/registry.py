"""All queries of the web-clip operators by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = "pages texts links blocks sequences paragraphs parts joins sinks live code bilingual streams elements".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows that an expression makes of a given table; ``{pages}`` and the like stand for tables in both engines."""
    return spark.sql(sql.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def same(sql: str) -> str:
    """The derived rows as DuckDB reads them."""
    return sql.format(**{t: t for t in TABLES})


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


@cache
def everything() -> Registry:
    """The queries of all plan modules."""
    out = Registry()
    for module in MODULES:
        part = importlib.import_module(f"quillmill.plans.{module}").registry
        out.queries |= part.queries
        out.sql |= part.sql
    return out
