"""Sharding: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm._util import apart, bucket_of, cut, number_rows, without

ROUNDS = 6
#: Sizes of so many files are broadcast at most; those of more are joined.
FILES_AT_ONCE = 100_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each number of [0, n) under a keyed bijection of [0, n).

    A balanced Feistel network permutes [0, 4**h), the least such power that holds n numbers; a result beyond n walks
    along its cycle until it comes back below n. Fewer than four steps are expected, and every walk ends.
    """
    half = np.uint64(max(1, (max(int(n) - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right + key) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = network(numbers.astype(np.uint64))
        while len(walk := np.flatnonzero(out >= np.uint64(n))):
            out[walk] = network(out[walk])
    return out.astype(np.int64)


def permuted(number: Column, total: Column, seed: int) -> Column:
    """``permute`` as a column; ``total`` holds one value in all rows."""

    @F.pandas_udf("long")
    def place(numbers: pd.Series, totals: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), int(totals.iloc[0]), seed) if len(numbers) else numbers)

    return place(number, total)


def shard_rows(numbered: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """Adds ``position``, ``shard`` and ``slot`` to rows that have ``row_number`` and ``rows_total``.

    position = permuted row number; shard = position mod shards; slot = position div shards. Shards differ by one row
    at most and slots have no gaps; anyone who knows a row's number, the row count, the shard count and the seed can
    compute both without looking at another row.
    """
    placed = numbered.withColumn("position", permuted(F.col("row_number"), F.col("rows_total"), seed))
    return placed.withColumn("shard", F.pmod(F.col("position"), F.lit(shards)).cast("int")).withColumn(
        "slot", F.floor(F.col("position") / F.lit(shards)).cast("long")
    )


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 42, buckets: int = 16384) -> DataFrame:
    """Shard and slot of every document, under the law ``rows``.

    The global row number is the rank of (hash bucket of doc_id, doc_id, checksum, size): it depends on the rows alone,
    not on files or partitions, so lost executors and other layouts give the same shuffle. Only ids, sizes and
    checksums are shuffled; texts stay where they are.

    Null text counts as empty (size 16, checksum 0). Null doc_ids are rows like others. Repeated rows are numbered one
    after another, and as they are equal it doesn't matter which gets which number. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    numbered = number_rows(rows, bucket_of([F.col("doc_id")], buckets), order)
    return shard_rows(numbered, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position"
    )


def shard_stored(docs: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """As ``shard_documents``, for a table read from Parquet files whose order matters; keeps the table's columns.

    The global row number is the row's place in the stored order (files by folder, by the number that Spark's writers
    give each, and by path; rows as they stand in each), which the file source tells for every row: no sort and no
    shuffle of rows, only a count for each file. Columns of the table that are named like one of the added columns
    (row_number, position, shard, slot) give way to it. Rows that come from no file are numbered by doc_id as in
    ``shard_documents``.
    """
    added = ["row_number", "position", "shard", "slot"]
    rows, of, back = apart(docs)
    back = without(back, docs, added)
    try:
        file = docs.metadataColumn("_metadata")
        file, local = file["file_path"], file["row_index"]
        docs.select(file, local).schema  # noqa: B018
    except AnalysisException:
        numbered = number_rows(rows, bucket_of([of("doc_id")], 16384), [of("doc_id"), F.xxhash64(of("text"))])
        return shard_rows(numbered, shards, seed).select(*back, *added)
    rows = docs.select(*[docs[f"`{c}`"].alias(f"in_{i}") for i, c in enumerate(docs.columns)], file.alias("file"), local.alias("local"))
    name = F.element_at(F.split("file", "/"), -1)
    folder = F.expr("substring(file, 1, length(file) - length(element_at(split(file, '/'), -1)))")
    order = Window.orderBy(folder, F.length(F.regexp_extract(name, r"^part-(\d+)", 1)), "file")
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(
        sizes.select(
            F.col("file").alias("of_file"),
            F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.sum("n").over(Window.partitionBy()).alias("rows_total"),
        )
    )
    small = F.broadcast if sizes.count() <= FILES_AT_ONCE else lambda df: df
    numbered = rows.join(small(sizes), F.col("file") == F.col("of_file")).withColumn("row_number", F.col("before") + F.col("local"))
    return shard_rows(numbered, shards, seed).select(*back, *added)
