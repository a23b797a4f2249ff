"""Filters by rule tables, and tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.urls import domain_of


def not_blocked(rows: DataFrame, hosts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows (url, ...) whose host isn't in ``hosts`` (host) and whose url starts with none of ``prefixes`` (prefix).

    Prefixes are looked up by equal length and text, one equi-join for all, so that a long rule table is no nested loop:
    a url is exploded into its beginnings of the lengths that occur.
    """
    kept = rows.join(hosts.select(F.col("host").alias("_host")), domain_of(F.col("url")) == F.col("_host"), "left_anti")
    rules = prefixes.where("prefix is not null").select(F.col("prefix").alias("_prefix")).distinct()
    lengths = rules.agg(F.sort_array(F.collect_set(F.length("_prefix"))).alias("_lengths"))
    # one row: the lengths that occur
    begun = kept.select("url").distinct().join(F.broadcast(lengths), F.size("_lengths") > 0)
    begun = begun.select("url", F.explode(F.expr("transform(filter(_lengths, n -> n <= length(url)), n -> substring(url, 1, n))")).alias("_start"))
    hit = begun.join(rules, F.col("_start") == F.col("_prefix")).select(F.col("url").alias("_url")).distinct()
    return kept.join(hit, F.col("url") == F.col("_url"), "left_anti")


def table_text(lines: DataFrame, header: list[str]) -> DataFrame:
    """(table_id, body) of rows (table_id, ord, line): a pipe table, header and separator first."""
    head = [" | ".join(header), " | ".join("---" for _ in header)]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return lines.groupBy("table_id").agg(F.array_join(F.concat(F.array(*[F.lit(h) for h in head]), rows), "\n").alias("body"))
