"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that setting is used as it is. Where it is unset, one
    machine that is driver and executor in one (master ``local``) takes a temporary folder; anything else is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmill-", dir=os.environ.get("TMPDIR")))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that no later step computes it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a row group of long rows, as stored.
LONG_ROWS = 1 << 22


def stored(df: DataFrame, long_rows: bool = False) -> tuple[DataFrame, str]:
    """As ``cut``, but as a compressed Parquet table in the shared folder, whose path comes along for ``forget``.

    ``long_rows`` says that a row holds arrays of many thousand values. Spark unpacks up to 4096 rows of a row group at once, several times
    their stored size; so row groups are kept small, and are measured after each row instead of every hundred.
    """
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    checks = {"parquet.block.size": LONG_ROWS, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    df.write.options(**checks if long_rows else {}).parquet(path)
    return spark.read.parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``stored``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Short rows (a few numbers) that are worth a task, and the tasks that few of them are dealt to.
ROWS_A_TASK, LEAST_TASKS = 1 << 16, 8


def pieces(rows: int) -> int:
    """How many tasks so many short rows need."""
    return max(LEAST_TASKS, -(-rows // ROWS_A_TASK))


#: Bytes of rows that go to Python at a time, and the setting that says so (64 MB by default).
BYTES_A_BATCH, BATCH_SETTING = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python about BYTES_A_BATCH at a time, unless it has a setting of its own.

    Buffers for tens of megabytes of text lie outside an executor's heap, in the JVM and in each Python worker.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BYTES_A_BATCH))


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def apart(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column], list[Column]]:
    """``df`` with columns in_0, in_1, ..., which meet no name that an operator uses inside; a function that finds a column by
    its own name; and the columns that bring all own names back."""
    names = [f"in_{i}" for i in range(len(df.columns))]

    def of(name: str) -> Column:
        exact = [n for n, c in zip(names, df.columns, strict=True) if c == name]
        return F.col((exact or [n for n, c in zip(names, df.columns, strict=True) if c.lower() == name.lower()])[0])

    return df.toDF(*names), of, [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)]


def without(back: list[Column], df: DataFrame, added: list[str]) -> list[Column]:
    """``back`` of ``apart`` less the columns named like ``added``."""
    return [b for b, c in zip(back, df.columns, strict=True) if c.lower() not in added]


def bucket_of(columns: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def number_rows(rows: DataFrame, bucket: Column, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """Adds ``row_number`` (gapless from 0) and ``rows_total``, over everything or over each value of ``within``.

    Neither the bucket nor a ``within`` column may be null. Rows are numbered bucket by bucket, so no task ever sorts more than one bucket, however many rows share a
    ``within`` key; only the table of bucket sizes (at most buckets x keys rows) is summed up in one place.
    """
    within = within or []
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    key = Window.partitionBy(*within)
    sizes = sizes.select(
        *[F.col(c).alias(f"_of_{c}") for c in within],
        F.col("_bucket").alias("_of_bucket"),
        F.coalesce(F.sum("_n").over(key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(key).alias("rows_total"),
    )
    local = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order)) - 1
    # plain equality keeps the partitioning of the numbered rows, so that they aren't shuffled again for the join
    same = F.col("_bucket") == F.col("_of_bucket")
    for c in within:
        same = same & (F.col(c) == F.col(f"_of_{c}"))
    return (
        rows.withColumn("_local", local)
        .join(sizes, same)
        .withColumn("row_number", F.col("_before") + F.col("_local"))
        .drop("_bucket", "_of_bucket", "_before", "_local", *[f"_of_{c}" for c in within])
    )
