"""Sources and sinks: event streams in, parts and exports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """Events as a stream of Parquet files; ts as a timestamp, as watermarks need it."""
    reader = spark.readStream.schema(EVENTS)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def write_parts(parts: DataFrame, path: str, by: str = "domain") -> None:
    """One record for each part, in a folder for each ``by``; rows of one folder meet in few tasks, so files stay large."""
    parts.repartition(F.col(by), F.pmod(F.xxhash64("clip_id"), F.lit(8))).write.mode("overwrite").partitionBy(by).parquet(path)


def merged_export(notes: DataFrame, key: str, order: str, title: str, body: str) -> DataFrame:
    """(key, text): the notes of each selection as one text, in order, each under its title."""
    part = F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.col(body))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t")))), lambda x: x["t"])
    return notes.groupBy(key).agg(F.array_join(texts, "\n\n").alias("text"))


def separate_export(notes: DataFrame, path: str, uuid: str = "uuid") -> None:
    """One folder for each note."""
    notes.write.mode("overwrite").partitionBy(uuid).parquet(path)
