"""Queries of exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.plans.registry import Registry, table
from quillmill.sources.parts import merged_export

registry = Registry()
query = registry.add


@query("export_sink", """
    SELECT o_custkey AS selection, string_agg(concat('# Order ', o_orderkey, chr(10), chr(10), o_orderpriority), chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey""")  # fmt: skip
def export_sink(spark, sf_dir):
    notes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("selection"), "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("body"))
    return merged_export(notes, "selection", "o_orderkey", "title", "body")
