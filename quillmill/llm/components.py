"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm._util import cut, pieces


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One star step (Kiveris et al., 2014): links neighbours of a node to the least of them.

    large: the larger neighbours of each node; else the node itself and its smaller ones. Minima are summed up before
    they are shuffled and come back by a join, so no task holds all neighbours of a node. Few edges are dealt to ``parts`` tasks at most.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["n"])
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the least node reachable.

    Large and small stars alternate until the edges stay the same, which takes about log(n) rounds. Each round is
    written to the shared checkpoint folder, so lineage stays short and a lost executor costs one round at most. The tasks of a
    round are as many as its edges need, however many shuffle partitions there are. Only a count and a checksum reach the driver. An edge from a node to itself, or a null end, adds nothing.
    """
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = cut(edges.select("a", "b").where("a != b").distinct())
    before, after = None, mark(now)
    while before != after and after[0]:
        before = after
        parts = pieces(after[0])
        now = cut(_star(_star(now.coalesce(parts), True, parts), False, parts))
        after = mark(now)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
